import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from wallflow.llm.packing import Tokens, _improved, best_fit, local_search, pack, sequences

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")

ODD = [
    None, "", " ", "a", "  two  spaces ", "new\n\n\nlines \n mixed\t\ttabs", "it's they're WE'LL don't", "naïve café №5 ½ ٣",
    "<|endoftext|> inside", "emoji \U0001f600‍\U0001f680 and \xa0nbsp　wide", "x" * 5_000, "word " * 4_000, "1,234.56%",
]


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def totals(bins):
    out = Counter()
    for contents, n in bins.items():
        for x in contents:
            out[x] += n
    return out


def squares(bins):
    return sum(sum(c) ** 2 * n for c, n in bins.items())


def test_ids_are_those_of_the_tokenizer_file(sample):
    tokens = Tokens(PATH)
    assert tokens.fast is not None
    for text in [x or "" for x in ODD] + [t for _, t, *_ in sample[:60]]:
        assert np.frombuffer(tokens.ids(text), dtype="<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_the_pieces_and_never_needs_more_bins(seed):
    rng = random.Random(seed)
    low, high = rng.choice([(1, 100), (20, 60), (30, 52), (34, 50)])
    lengths = Counter(rng.randint(low, high) for _ in range(400))
    first = best_fit(lengths, 100)
    better = local_search(first, 100)
    for bins in (first, better):
        assert totals(bins) == lengths
        assert all(0 < sum(c) <= 100 for c in bins)
    assert sum(better.values()) <= sum(first.values())
    assert squares(better) >= squares(first)


def test_each_kind_of_step():
    # A move: one piece fits beside another. One for one: 40 for 50. Two for one: 30 and 30 for 60.
    assert sum(local_search(Counter({(60,): 1, (40,): 1}), 100).values()) == 1
    assert local_search(Counter({(50, 40): 1, (50,): 1, (40,): 1, (20,): 1}), 100) == Counter({(50, 50): 1, (40, 40, 20): 1})
    swapped = local_search(Counter({(60, 35): 1, (30, 10, 25): 1, (40,): 1}), 100)
    assert sum(swapped.values()) == 2


def test_equal_bins_move_together():
    got = local_search(Counter({(60,): 10**9, (40,): 10**9}), 100)
    assert got == Counter({(60, 40): 10**9})


def test_nothing_to_pack():
    assert local_search(best_fit({}, 100), 100) == Counter()


def check(rows, got, capacity):
    cut = {}
    for r in got:
        cut.setdefault(r.doc_id, []).append(r)
    want = Counter()
    for i, t in rows:
        ids, sizes = ids_of(t), [r.length for r in sorted(cut[i], key=lambda r: r.piece)]
        want[i] += 1
        if want[i] == 1 and sum(k == i for k, _ in rows) == 1:
            assert sum(sizes) == len(ids)
            assert all(n == capacity for n in sizes[1:]) and (len(ids) > capacity or len(sizes) == 1)
            for r in cut[i]:
                piece = np.array(ids[r.start : r.start + r.length], dtype="<u4")
                assert r.ids_crc32 == zlib.crc32(piece.tobytes())
    placed = {}
    for r in got:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in placed.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(placed)


def test_places(docs, sample):
    rows = [(i, t) for i, t, *_ in sample] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(5000, "again")] * 3 + [(None, "null id")]
    got = pack(docs(rows).repartition(5), PATH).collect()
    used = check(rows, got, 1024)
    assert sum(r.doc_id == 5000 for r in got) == 3
    assert used <= -(-sum(r.length for r in got) // 1024) + 2


def test_one_common_length_and_small_sequences(docs):
    rows = [(i, "one two three") for i in range(500)] + [(1000 + i, "a " * i) for i in range(60)]
    assert check(rows, pack(docs(rows).repartition(7), PATH, capacity=16).collect(), 16)


def test_sequences_hold_the_tokens(docs):
    rows = [(i, f"text {i} " * (3 * i)) for i in range(40)]
    table = docs(rows)
    placed = pack(table, PATH, capacity=64)
    got = {r.sequence_id: r.ids for r in sequences(table, placed, PATH).collect()}
    for r in placed.collect():
        part = ids_of(dict(rows)[r.doc_id])[r.start : r.start + r.length]
        assert got[r.sequence_id][r.offset : r.offset + r.length] == part


def test_empty_table(docs):
    assert pack(docs([]), PATH).collect() == []


def test_search_ends_where_no_two_bins_can_be_improved():
    rng = random.Random(6)
    lengths = Counter(rng.randrange(20, 70) for _ in range(200))
    first = best_fit(lengths, 100)
    bins = local_search(first, 100)
    total = sum(x * n for x, n in lengths.items())
    assert -(-total // 100) <= sum(bins.values()) <= sum(first.values())
    if sum(bins.values()) > -(-total // 100):
        kinds = [c for c in bins if sum(c) < 100]
        for a in kinds:
            for b in kinds:
                if (a != b or bins[a] > 1) and (-sum(a), a) <= (-sum(b), b):
                    assert _improved(a, b, 100) is None
