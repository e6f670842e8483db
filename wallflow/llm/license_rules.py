"""Signature rules of the licence scan.

One rule a line: label, priority, keyword, pattern. A pattern is tried only on
texts that contain its keyword, whatever stands between the words of either. A
space in a pattern stands for any run of characters that are neither letters nor
digits; patterns match whole words of the text with A-Z in lower case.
"""

from __future__ import annotations

NAMED = r"""
mit|80|mit|mit licen[sc]e
mit|70|the mit|(?:under|uses?|by) the mit(?: terms)?
mit|75|mit|mit x11 licen[sc]e
mit|60|expat|expat licen[sc]e
mit|90|permission|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|75|permission|the above copyright notice and this permission notice shall be included in all copies
mit-0|85|mit|mit no attribution
mit-0|80|mit-0|mit 0 licen[sc]e
x11|75|x11|x11 licen[sc]e
apache|80|apache|apache licen[sc]e
apache-2.0|90|apache|apache licen[sc]e version 2(?: 0)?
apache-2.0|88|apache|apache licen[sc]e v?2(?: 0)?
apache-2.0|85|apache|apache software licen[sc]e version 2(?: 0)?
apache-2.0|85|apache|apache 2(?: 0)? licen[sc]e
apache-2.0|85|licen|you may not use this file except in compliance with the licen[sc]e
apache-2.0|80|licen|unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-1.1|85|apache|apache(?: software)? licen[sc]e version 1 1
apache-1.0|85|apache|apache(?: software)? licen[sc]e version 1 0
gpl|80|general|general public licen[sc]e
gpl|75|gpl|gnu gpl
gpl|60|gpl|gpl licensed
gpl-1.0|90|general|gnu general public licen[sc]e version 1(?: 0)?
gpl-2.0|90|general|gnu general public licen[sc]e version 2(?: 0)?
gpl-2.0|85|gpl|gpl ?v?2(?: 0)?(?: only)?
gpl-2.0-or-later|95|general|gnu general public licen[sc]e version 2(?: 0)? or at your option any later version
gpl-2.0-or-later|92|general|general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-2.0-or-later|90|gpl|gpl ?v?2(?: 0)? or later
gpl-3.0|90|general|gnu general public licen[sc]e version 3(?: 0)?
gpl-3.0|85|gpl|gpl ?v?3(?: 0)?(?: only)?
gpl-3.0-or-later|95|general|gnu general public licen[sc]e version 3(?: 0)? or at your option any later version
gpl-3.0-or-later|92|general|general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-3.0-or-later|90|gpl|gpl ?v?3(?: 0)? or later
lgpl|82|lesser|lesser general public licen[sc]e
lgpl|82|library|library general public licen[sc]e
lgpl|70|lgpl|lgpl licen[sc]ed?
lgpl-2.0|90|library|gnu library general public licen[sc]e version 2(?: 0)?
lgpl-2.1|92|lesser|gnu lesser general public licen[sc]e version 2 1
lgpl-2.1|85|lgpl|lgpl ?v?2 1
lgpl-3.0|92|lesser|gnu lesser general public licen[sc]e version 3(?: 0)?
lgpl-3.0|85|lgpl|lgpl ?v?3(?: 0)?
agpl|83|affero|affero general public licen[sc]e
agpl-3.0|93|affero|gnu affero general public licen[sc]e version 3(?: 0)?
agpl-3.0|85|agpl|agpl ?v?3(?: 0)?
agpl-1.0|88|affero|affero general public licen[sc]e version 1(?: 0)?
gfdl|80|free documentation|gnu free documentation licen[sc]e
gfdl-1.1|90|free documentation|gnu free documentation licen[sc]e version 1 1
gfdl-1.2|90|free documentation|gnu free documentation licen[sc]e version 1 2
gfdl-1.3|90|free documentation|gnu free documentation licen[sc]e version 1 3
gpl-classpath|88|classpath|gpl.{0,40} with(?: the)? classpath exception
gpl-linking|78|exception|special exception the copyright holders(?: of this library)? give you permission to link
bsd|75|bsd|bsd licen[sc]e
bsd|70|bsd|bsd style licen[sc]e
bsd-2-clause|88|bsd|(?:simplified|2 clause|two clause|freebsd) bsd(?: licen[sc]e)?
bsd-2-clause|85|bsd|bsd 2 clause(?: licen[sc]e)?
bsd-3-clause|88|bsd|(?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)?
bsd-3-clause|85|bsd|bsd 3 clause(?: licen[sc]e)?
bsd-4-clause|88|bsd|(?:original|old|4 clause|four clause) bsd(?: licen[sc]e)?
bsd-4-clause|80|advertising|all advertising materials mentioning features or use of this software must display
bsd-3-clause|80|contributors|neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd|78|redistribut|redistribution and use in source and binary forms with or without modification are permitted
0bsd|85|bsd|(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?
bsd-patent|85|bsd|bsd(?: 2 clause)? plus patent(?: licen[sc]e)?
mpl|75|mozilla|mozilla public licen[sc]e
mpl-1.0|90|mozilla|mozilla public licen[sc]e (?:version|v) ?1 0
mpl-1.1|90|mozilla|mozilla public licen[sc]e (?:version|v) ?1 1
mpl-2.0|90|mozilla|mozilla public licen[sc]e (?:version |v ?)?2 0
mpl-2.0|85|mpl|mpl ?v?2(?: 0)?
mpl-1.1|83|mpl|mpl ?v?1 1
epl|75|eclipse|eclipse public licen[sc]e
epl-1.0|90|eclipse|eclipse public licen[sc]e (?:version |v ?)?1 0
epl-2.0|90|eclipse|eclipse public licen[sc]e (?:version |v ?)?2 0
edl-1.0|85|eclipse|eclipse distribution licen[sc]e(?: version 1 0)?
cddl|75|common development|common development and distribution licen[sc]e
cddl-1.0|90|common development|common development and distribution licen[sc]e version 1 0
cddl-1.1|90|common development|common development and distribution licen[sc]e version 1 1
cpl-1.0|85|common public|common public licen[sc]e(?: version 1 0)?
cpal-1.0|85|common public|common public attribution licen[sc]e(?: version 1 0)?
ipl-1.0|85|ibm|ibm public licen[sc]e(?: version 1 0)?
eupl|75|european union|european union public licen[sc]e
eupl-1.1|90|european union|european union public licen[sc]e v(?:ersion)? ?1 1
eupl-1.2|90|european union|european union public licen[sc]e v(?:ersion)? ?1 2
cecill|75|cecill|cecill(?: free software)? licen[sc]e
cecill-2.0|85|cecill|cecill v?2 0
cecill-2.1|85|cecill|cecill v?2 1
cecill-b|85|cecill|cecill b
cecill-c|85|cecill|cecill c
artistic|75|artistic|artistic licen[sc]e
artistic-1.0|88|artistic|artistic licen[sc]e 1 0
artistic-2.0|88|artistic|artistic licen[sc]e(?: version)? 2 0
artistic-perl|80|perl|under the same terms as perl(?: itself)?
isc|80|isc|isc licen[sc]e
isc|75|permission|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
zlib|80|zlib|zlib(?: libpng)? licen[sc]e
zlib|75|warrant|this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng|80|libpng|libpng licen[sc]e(?: version 2)?
bsl-1.0|85|boost|boost software licen[sc]e(?: version 1 0)?
unlicense|85|unlicense|(?:the )?unlicense
unlicense|80|public domain|this is free and unencumbered software released into the public domain
wtfpl|85|wtfpl|wtfpl(?: version 2)?
wtfpl|80|what the|do what the f\S{1,6} you want to public licen[sc]e
public-domain|70|public domain|(?:placed|released|dedicated|is) (?:in|into|to) the public domain
public-domain|60|public domain|public domain dedication
cc0-1.0|90|cc0|cc0(?: 1 0)?(?: universal)?
cc0-1.0|85|creative commons|creative commons zero(?: v?1 0)?
cc|65|creative commons|creative commons licen[sc]e
cc-by|80|creative commons|creative commons attribution(?: licen[sc]e)?
cc-by-3.0|90|creative commons|creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-4.0|90|creative commons|creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa|82|creative commons|creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-sa-3.0|92|creative commons|creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-4.0|92|creative commons|creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc|82|creative commons|creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nc-4.0|92|creative commons|creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nd|82|creative commons|creative commons attribution no ?deriv(?:ative)?s?(?: licen[sc]e)?
cc-by-nc-sa|84|creative commons|creative commons attribution non ?commercial share ?alike(?: [34] 0)?
cc-by-nc-nd|84|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [34] 0)?
cc-by|78|cc by|cc by(?: [1-4] [05])?
cc-by-sa|80|cc by|cc by sa(?: [1-4] [05])?
cc-by-nc|80|cc by|cc by nc(?: [1-4] [05])?
cc-by-nd|80|cc by|cc by nd(?: [1-4] [05])?
cc-by-nc-sa|82|cc by|cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd|82|cc by|cc by nc nd(?: [1-4] [05])?
ofl-1.1|85|open font|sil open font licen[sc]e(?: version 1 1)?
ofl-1.0|86|open font|sil open font licen[sc]e version 1 0
odbl-1.0|85|open database|open database licen[sc]e(?: v?1 0)?
odc-by-1.0|85|open data|open data commons attribution licen[sc]e
pddl-1.0|85|public domain|(?:open data commons )?public domain dedication (?:and|&) licen[sc]e
psf-2.0|85|python|python software foundation licen[sc]e(?: version 2)?
python-2.0|80|python|python licen[sc]e(?: version)? 2 0
php-3.01|85|php|php licen[sc]e(?: version)? 3 01
php-3.0|80|php|php licen[sc]e(?: version 3 0)?
ruby|75|ruby|ruby licen[sc]e
ncsa|85|illinois|university of illinois ncsa open source licen[sc]e
ncsa|75|ncsa|ncsa open source licen[sc]e
w3c|80|w3c|w3c software(?: notice and)? licen[sc]e
openssl|85|openssl|openssl licen[sc]e
ssleay|80|ssleay|(?:original )?ssleay licen[sc]e
icu|80|icu|icu licen[sc]e
unicode-dfs|80|unicode|unicode(?: inc)? licen[sc]e agreement
curl|78|curl|curl licen[sc]e
ijg|80|jpeg|independent jpeg group(?: s)? licen[sc]e
ms-pl|85|microsoft|microsoft public licen[sc]e
ms-rl|85|microsoft|microsoft reciprocal licen[sc]e
ms-eula|75|microsoft|microsoft software licen[sc]e terms
upl-1.0|85|universal|universal permissive licen[sc]e(?: v(?:ersion)? ?1 0)?
osl-3.0|88|open software|open software licen[sc]e(?: v(?:ersion)?)? ?3 0
osl|75|open software|open software licen[sc]e
afl-3.0|88|academic free|academic free licen[sc]e(?: v(?:ersion)?)? ?3 0
afl|75|academic free|academic free licen[sc]e
ecl-2.0|85|educational|educational community licen[sc]e(?: version 2 0)?
apsl-2.0|88|apple|apple public source licen[sc]e(?: version)? 2 0
apsl|75|apple|apple public source licen[sc]e
qpl-1.0|80|q public|q public licen[sc]e
sleepycat|80|sleepycat|sleepycat(?: public)? licen[sc]e
postgresql|80|postgresql|postgresql licen[sc]e
vim|78|vim|vim licen[sc]e
beerware|80|beer|beer ?ware licen[sc]e
fair|75|fair|fair licen[sc]e
json|80|json|json licen[sc]e
json|82|good not evil|software shall be used for good not evil
mulan-2.0|85|mulan|mulan (?:psl|permissive software licen[sc]e) v?(?:ersion )?2
nasa-1.3|80|nasa|nasa open source agreement(?: 1 3)?
rpl-1.5|80|reciprocal|reciprocal public licen[sc]e(?: 1 5)?
sspl-1.0|85|server side|server side public licen[sc]e(?: v?1(?: 0)?)?
busl-1.1|85|business source|business source licen[sc]e(?: 1 1)?
elastic-2.0|85|elastic|elastic licen[sc]e(?: v?2(?: 0)?)?
commons-clause|85|commons clause|commons clause(?: licen[sc]e)?(?: condition)?(?: v?1 0)?
polyform|80|polyform|polyform (?:noncommercial|perimeter|shield|strict|small business|free trial)(?: licen[sc]e)?(?: 1 0 0)?
openrail|82|rail|(?:creativeml )?open ?rail(?: \+?\+?)?(?: m)?(?: licen[sc]e)?
bigscience-rail|84|bigscience|bigscience (?:open )?rail(?: m)?(?: licen[sc]e)?
llama-community|84|llama|llama [23](?: [0-9])? community licen[sc]e
gemma-terms|78|gemma|gemma terms of use
bittorrent|80|bittorrent|bittorrent open source licen[sc]e
blueoak-1.0|82|blue oak|blue oak model licen[sc]e(?: 1 0 0)?
parity|78|parity|parity public licen[sc]e
hippocratic|80|hippocratic|hippocratic licen[sc]e
watcom|80|watcom|sybase open watcom public licen[sc]e
nokia|78|nokia|nokia open source licen[sc]e
sun-bcl|80|sun|sun binary code licen[sc]e
sissl|80|sun|sun industry standards source licen[sc]e
spl-1.0|80|sun|sun public licen[sc]e(?: version 1 0)?
oracle-bcl|78|oracle|oracle binary code licen[sc]e agreement
otn|75|oracle|oracle technology network licen[sc]e
intel-ssl|75|intel|intel simplified software licen[sc]e
nvidia-eula|75|nvidia|nvidia software licen[sc]e
aladdin|80|aladdin|aladdin free public licen[sc]e
interbase|78|interbase|interbase public licen[sc]e
latex-lppl|80|latex|latex project public licen[sc]e
latex-lppl-1.3c|88|latex|latex project public licen[sc]e(?: v(?:ersion)?)? ?1 3c
bitstream-vera|80|bitstream|bitstream vera(?: fonts)? (?:copyright|licen[sc]e)
etalab-2.0|80|etalab|etalab(?: open)? licen[sc]e(?: 2 0)?
ogl-uk-3.0|82|open government|open government licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?
dl-de-by|78|datenlizenz|datenlizenz deutschland namensnennung(?: 2 0)?
proprietary|55|all rights reserved|all rights reserved
proprietary|60|confidential|proprietary and confidential
proprietary|60|proprietary|proprietary licen[sc]e
commercial|60|commercial|commercial licen[sc]e
non-commercial|62|commercial|for non ?commercial (?:use|purposes) only
no-warranty|40|warrant|(?:without warranty of any kind|without any warranty)
as-is|40|warrant|as is without warrant(?:y|ies)
copyright|35|copyright|copyright (?:c )?(?:19|20)[0-9][0-9]
free-software|45|free software|is free software you can redistribute it and or modify it
open-source|40|open source|open source licen[sc]e
see-license|30|licen|see (?:the )?(?:file )?licen[sc]e (?:file )?for (?:details|more|the terms)
see-license|30|copying|see (?:the )?(?:file )?copying (?:file )?for (?:details|more|the terms)
"""

# Pages and identifiers: label, priority, keyword, pattern.
LINKS = r"""
apache-2.0|92|apache.org|apache org licenses license 2 0
mit|90|opensource.org|opensource org licen[sc]es? mit
bsd-3-clause|90|opensource.org|opensource org licen[sc]es? bsd 3 clause
bsd-2-clause|90|opensource.org|opensource org licen[sc]es? bsd 2 clause
isc|90|opensource.org|opensource org licen[sc]es? isc
artistic-2.0|90|opensource.org|opensource org licen[sc]es? artistic 2 0
gpl-3.0|90|gnu.org|gnu org licenses gpl 3 0
gpl-2.0|90|gnu.org|gnu org licenses(?: old licenses)? gpl 2 0
lgpl-2.1|90|gnu.org|gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-3.0|90|gnu.org|gnu org licenses lgpl 3 0
agpl-3.0|90|gnu.org|gnu org licenses agpl 3 0
gfdl-1.3|88|gnu.org|gnu org licenses fdl 1 3
gpl|70|gnu.org|gnu org licenses gpl
mpl-2.0|92|mozilla.org|mozilla org mpl 2 0
mpl-1.1|92|mozilla.org|mozilla org mpl 1 1
epl-2.0|90|eclipse.org|eclipse org (?:legal|org documents) epl 2 0
epl-1.0|90|eclipse.org|eclipse org (?:legal|org documents) epl v10
bsl-1.0|90|boost.org|boost org license 1 0
unlicense|90|unlicense|unlicense org
wtfpl|88|wtfpl|wtfpl net
ofl-1.1|90|scripts.sil.org|scripts sil org ofl
cc0-1.0|92|creativecommons|creativecommons org publicdomain zero 1 0
cc-by-4.0|92|creativecommons|creativecommons org licenses by 4 0
cc-by-3.0|92|creativecommons|creativecommons org licenses by 3 0
cc-by-sa-4.0|92|creativecommons|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|92|creativecommons|creativecommons org licenses by sa 3 0
cc-by-nc-4.0|92|creativecommons|creativecommons org licenses by nc 4 0
cc-by-nd-4.0|92|creativecommons|creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0|92|creativecommons|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|92|creativecommons|creativecommons org licenses by nc nd 4 0
"""

# Identifiers in licence tags of source files.
TAGS = """
0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause
bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1
cpal-1.0 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3-only gpl-1.0-only gpl-2.0-only gpl-2.0-or-later
gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0-only lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later mit
mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0
python-2.0 ruby sspl-1.0 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib
"""

_GAP = "[^a-z0-9]++"


def _compiled(pattern: str) -> str:
    """A space not followed by ``?`` is a gap; with it, an optional one."""
    words = pattern.replace(" ?", "[^a-z0-9]*+").replace(" ", _GAP)
    return f"(?<![a-z0-9])(?:{words})(?![a-z0-9])"


def rules() -> list[dict]:
    """All rules as ``label, priority, keyword, regex``."""
    out = []
    for line in (NAMED + LINKS).strip().splitlines():
        if line:
            label, priority, keyword, pattern = line.split("|", 3)
            out.append((label, int(priority), keyword, _compiled(pattern)))
    for tag in TAGS.split():
        name = tag.replace("-", " ").replace(".", " ")
        out.append((tag, 98, "spdx", _compiled(f"spdx license identifier {name}")))
    return [dict(zip(("label", "priority", "keyword", "regex"), r, strict=True)) for r in out]
