"""File-to-file verbs. Each computes its table once, then writes all outputs from it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.operators.dependencies import known_names
from wallflow.operators.flows import flow_rollup
from wallflow.operators.hosts import host_objects
from wallflow.plans.comparison import commands_for_missing, missing_rules
from wallflow.plans.conversion import conversion_counts, convert_rules, converted_missing
from wallflow.plans.duplicates import FILTER, NAT, duplicate_members, duplicate_removals
from wallflow.plans.suggestions import suggest_rules
from wallflow.session import materialise, scratch
from wallflow.sinks import scripts, tables
from wallflow.sinks.lines import write_lines
from wallflow.sources.listing import ReadReport
from wallflow.sources.logs import ORDER, read_logs
from wallflow.sources.names import newest_lists, read_interfaces, read_objects
from wallflow.sources.rules import read_rules


def _now(generated_at: str | None) -> str:
    return generated_at or datetime.now().isoformat(timespec="seconds")


def _rules(
    spark: SparkSession,
    paths: str | Sequence[str],
    multi_line: bool | None,
    may_be_empty: bool = False,
    report: ReadReport | None = None,
) -> DataFrame:
    """Rules of the files, parsed and numbered once for all passes over them."""
    return materialise(read_rules(spark, paths, multi_line=multi_line, may_be_empty=may_be_empty, report=report), "rules")


def _newest(
    spark: SparkSession, folder: str | None, objects: str | None, interfaces: str | None
) -> tuple[str | None, str | None]:
    """The lists to check against: the newest of ``folder`` where none are named."""
    newest = newest_lists(spark, folder) if folder else ("", "")
    return objects or newest[0] or None, interfaces or newest[1] or None


def _known(spark: SparkSession, objects: str | None, interfaces: str | None) -> DataFrame:
    return known_names(read_objects(spark, objects), read_interfaces(spark, interfaces))


def analyse_logs(
    spark: SparkSession,
    path: str,
    out: str,
    *,
    time_formats: Sequence[str] = (),
    multi_line: bool | None = None,
    same_header: bool = False,
    k: int = 10,
    exact: bool = True,
    vote: bool = False,
    report: ReadReport | None = None,
) -> DataFrame:
    """Write ``analyzed_logs`` and ``analysis_summary``; return the flow table.

    Volumes are summed exactly unless ``exact`` is off. ``vote`` finds the time
    pattern of each file. Files left out are listed in ``report``.
    """
    logs = read_logs(spark, path, multi_line=multi_line, same_header=same_header, with_order=True, report=report)
    rollup = flow_rollup(logs, tie_break=ORDER, time_formats=time_formats, exact=exact, vote_by=ORDER[0] if vote else None)
    flows = materialise(rollup, "flows")
    tables.write_flows(flows, f"{out}/analyzed_logs")
    tables.write_summary(flows, f"{out}/analysis_summary", k)
    return flows


def append_suggestions(
    flows: DataFrame,
    out: str,
    *,
    objects: str | None = None,
    interfaces: str | None = None,
    reference_folder: str | None = None,
    generated_at: str | None = None,
    only_complete: bool = True,
    **options,
) -> DataFrame:
    """Append rules for the top flows to ``generated_rules_from_logs``.

    ``only_complete`` leaves out those that use unknown names; known are those
    of the lists named, or of the newest ones in ``reference_folder``.
    """
    objects, interfaces = _newest(flows.sparkSession, reference_folder, objects, interfaces)
    found = materialise(suggest_rules(flows, _known(flows.sparkSession, objects, interfaces), **options), "suggested")
    chosen = found.filter("size(missing) = 0") if only_complete else found
    text = scripts.suggested_rule_lines(chosen, generated_at=_now(generated_at))
    write_lines(text, f"{out}/generated_rules_from_logs", mode="append")
    return found


def convert_files(
    spark: SparkSession,
    paths: Sequence[str],
    out: str,
    *,
    objects: str | None = None,
    interfaces: str | None = None,
    reference_folder: str | None = None,
    slot: int = 9,
    start: int = 1,
    prefix: str = "",
    create_hosts: bool = False,
    activate: bool = True,
    group_by_10: bool = True,
    multi_line: bool | None = None,
    generated_at: str | None = None,
    report: ReadReport | None = None,
) -> dict[str, int]:
    """Write ``rules_safe``, ``rules_pending`` and ``dependencies_missing``; return the counters.

    Rule files left out are listed in ``report``.
    """
    at = _now(generated_at)
    objects, interfaces = _newest(spark, reference_folder, objects, interfaces)
    with scratch(spark):
        rules = _rules(spark, paths, multi_line, report=report)
        converted = materialise(
            convert_rules(
                rules, _known(spark, objects, interfaces),
                default_slot=slot, start=start, prefix=prefix, create_hosts=create_hosts,
            ),
            "converted",
        )
        hosts = materialise(host_objects(rules), "hosts") if create_hosts else None
        counts = conversion_counts(rules, converted, create_hosts).first().asDict()
        safe = scripts.safe_script(
            converted, hosts, sources=[p.rstrip("/").rsplit("/", 1)[-1] for p in paths], generated_at=at,
            slot=slot, start=start, activate=activate, group_by_10=group_by_10,
        )
        write_lines(safe, f"{out}/rules_safe")
        if counts["pending"]:
            write_lines(scripts.pending_script(converted, generated_at=at), f"{out}/rules_pending")
        if counts["missing"]:
            missing = scripts.missing_list(converted_missing(converted), generated_at=at)
            write_lines(missing, f"{out}/dependencies_missing", scripts.MISSING_ORDER)
    return counts


def compare_files(
    spark: SparkSession,
    source_paths: Sequence[str],
    final_path: str,
    out: str,
    *,
    slot: int = 9,
    start: int = 1,
    multi_line: bool | None = None,
    generated_at: str | None = None,
    report: ReadReport | None = None,
) -> int:
    """Write ``missing_rules_commands`` and ``missing_rules_summary``; return the number missing.

    Rules that no command can be built for are listed in ``missing_rules_unbuilt``.
    A final set without rules means that all are missing.
    """
    with scratch(spark):
        source = _rules(spark, source_paths, multi_line, report=report)
        final = _rules(spark, final_path, multi_line, may_be_empty=True, report=report)
        missing = materialise(missing_rules(source, final, start=start), "missing")
        commands = materialise(commands_for_missing(missing, slot=slot), "commands")
        counts = commands.agg(F.count(F.lit(1)).alias("n"), F.count("command").alias("built")).first()
        if counts["built"] < counts["n"]:
            write_lines(scripts.unbuilt_rule_lines(commands), f"{out}/missing_rules_unbuilt")
        if counts["built"]:
            script = scripts.missing_rules_script(commands, generated_at=_now(generated_at))
            write_lines(script, f"{out}/missing_rules_commands")
            tables.write_missing_summary(missing, f"{out}/missing_rules_summary")
    return counts["n"]


def find_duplicates_in_files(
    spark: SparkSession,
    paths: Sequence[str],
    out: str,
    *,
    slot: int = 9,
    is_global: bool = False,
    multi_line: bool | None = None,
    report: ReadReport | None = None,
) -> dict[str, int]:
    """Write both duplicate reports and, if anything is to go, the removal script.

    Returns the number of groups of each kind and of removal commands.
    """
    with scratch(spark):
        rules = _rules(spark, paths, multi_line, report=report)
        members = materialise(duplicate_members(rules, with_nat_lines=True), "members")
        for kind, name in ((FILTER, "duplicate_rules_report"), (NAT, "duplicate_nat_report")):
            write_lines(scripts.duplicate_report(members, kind), f"{out}/{name}", scripts.REPORT_ORDER)
        removals = materialise(duplicate_removals(rules, slot=slot, is_global=is_global, members=members), "removals")
        script = scripts.removal_script(removals)
        if script is not None:
            write_lines(script, f"{out}/delete_duplicates_script", scripts.REMOVAL_ORDER)
        groups = {r["kind"]: r["count"] for r in members.filter("is_kept").groupBy("kind").count().collect()}
        return {"filter": groups.get(FILTER, 0), "nat": groups.get(NAT, 0), "removals": removals.count()}
