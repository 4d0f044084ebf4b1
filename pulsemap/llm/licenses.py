"""License scans: ordered signature rules over normalised words.

A text becomes its lower-cased words (A-Z only), and rules are regular expressions over the words joined
by single spaces.  A rule runs only if one of its keywords, of which every match holds one, is a word of
the text.  Detections are taken in order of priority, then length, then place, then rule; one that lies
inside an interval already taken is suppressed, found in logarithmic time.  The three base phrases are
found everywhere, whatever the rules decide, and their labels always stay.

Contract: a null text is an empty one, without words; texts are scanned whole, in a time that hardly
grows faster than their length; equal texts have equal results, repeated rows are scanned each; an empty
table gives no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import python_ready, texts

#: Phrase and label of the base.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, priority, score, keywords (one of them is a whole word of every match), regular expression over words. Hand-written; The keyword
#: of "al 2" is one elsewhere in the text, as it means the license only there. V stands for an optional "version" or "v".
RULES = r"""
mit 80 1.0 license|licence (?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit licen[sc]e
mit 75 .95 permission permission is hereby granted free of charge to any person obtaining a copy of this software
mit 75 .95 permission permission is hereby granted free of charge to any person obtaining a copy
mit 70 .9 spdx spdx license identifier mit
mit 60 .8 license|licence the mit licen[sc]e(?: mit)?
mit 60 .8 opensource opensource org licenses mit
mit 50 .7 license|licence|licensed|licenced mit licen[sc]e(?:d)?
mit 50 .7 licensed mit licensed
mit 40 .6 expat expat licen[sc]e
mit-0 75 .9 mit mit no attribution
mit-0 70 .9 spdx spdx license identifier mit 0
x11 60 .8 x11 (?:mit )?x11 licen[sc]e
apache-2 85 1.0 apache licensed under the apache licen[sc]e V2(?: 0)?(?: the license)?
apache-2 80 .95 apache you may not use this file except in compliance with the license(?: \S+){0,40} www apache org licenses license 2 0
apache-2 70 .9 spdx spdx license identifier apache 2 0
apache-2 70 .9 apache apache (?:software )?licen[sc]e V2(?: 0)?
apache-2 60 .85 apache (?:www )?apache org licenses(?: license)? 2 0
apache-2 55 .8 apache apache 2(?: 0)? licen[sc]ed?
apache-2 45 .7 asl asl 2(?: 0)?
apache-2 45 .7 apache (?:asl|al) 2(?: 0)?
apache-1.1 70 .9 apache apache (?:software )?licen[sc]e V1 1
apache-1.0 68 .9 apache apache (?:software )?licen[sc]e V1 0
apache 30 .5 apache apache (?:software )?licen[sc]e
bsd-3-clause 80 .95 bsd licensed under (?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?
bsd-3-clause 75 .9 contributors neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse
bsd-3-clause 70 .9 spdx spdx license identifier bsd 3 clause
bsd-3-clause 60 .8 bsd (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-3-clause 55 .8 opensource opensource org licenses bsd 3 clause
bsd-2-clause 80 .95 bsd|freebsd licensed under (?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-2-clause 70 .9 spdx spdx license identifier bsd 2 clause
bsd-2-clause 60 .8 bsd (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[sc]e)?
bsd-2-clause 55 .8 opensource opensource org licenses bsd 2 clause
bsd-2-clause 50 .7 freebsd freebsd licen[sc]e
bsd-4-clause 70 .9 spdx spdx license identifier bsd 4 clause
bsd-4-clause 60 .8 bsd (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd-4-clause 55 .8 advertising all advertising materials mentioning features or use of this software must display
bsd-0-clause 70 .9 bsd|0bsd (?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?
bsd-0-clause 70 .9 0bsd (?:spdx license identifier )?0bsd
bsd 35 .6 bsd bsd (?:style )?licen[sc]ed?
bsd 35 .6 bsd under (?:the )?bsd
isc 75 .9 isc licensed under (?:the )?isc(?: licen[sc]e)?
isc 70 .9 spdx spdx license identifier isc
isc 60 .8 isc isc licen[sc]e
isc 60 .85 permission permission to use copy modify and or distribute this software for any purpose with or without fee
gpl-3 85 1.0 gnu licensed under (?:the )?(?:terms of the )?gnu general public licen[sc]e V3(?: 0)?
gpl-3 80 .95 gnu gnu general public licen[sc]e V3(?: 0)?
gpl-3 75 .9 spdx spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 70 .9 gpl gpl V3(?: 0)?(?: only| or later)?
gpl-3 70 .9 gplv3 (?:gnu )?gplv3
gpl-3 70 .9 gpl3 (?:gnu )?gpl3
gpl-3 60 .8 gnu gnu org licenses gpl 3 0
gpl-3-or-later 90 .95 gnu gnu general public licen[sc]e(?: \S+){0,12} (?:either )?V3 (?:of the license )?or (?:at your option )?any later version
gpl-2 85 1.0 gnu licensed under (?:the )?(?:terms of the )?gnu general public licen[sc]e V2(?: 0)?
gpl-2 80 .95 gnu gnu general public licen[sc]e V2(?: 0)?
gpl-2 75 .9 spdx spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 70 .9 gpl gpl V2(?: 0)?(?: only| or later)?
gpl-2 70 .9 gplv2 (?:gnu )?gplv2
gpl-2 70 .9 gpl2 (?:gnu )?gpl2
gpl-2-or-later 90 .95 gnu gnu general public licen[sc]e(?: \S+){0,12} (?:either )?V2 (?:of the license )?or (?:at your option )?any later version
gpl-1 70 .9 gnu gnu general public licen[sc]e V1(?: 0)?
gpl 50 .7 gnu gnu general public licen[sc]e
gpl 45 .7 gpl (?:gnu )?gpl(?: licen[sc]ed?)?
lgpl-3 85 .95 lesser gnu lesser general public licen[sc]e V3(?: 0)?
lgpl-3 75 .9 spdx spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 70 .9 lgpl lgpl V3(?: 0)?
lgpl-3 70 .9 lgplv3 (?:gnu )?lgplv3
lgpl-2.1 85 .95 lesser gnu lesser general public licen[sc]e V2 1
lgpl-2.1 75 .9 spdx spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 70 .9 lgpl lgpl V2 1
lgpl-2.1 70 .9 lgplv2 (?:gnu )?lgplv2(?: 1)?
lgpl-2 80 .95 library gnu library general public licen[sc]e V2(?: 0)?
lgpl 50 .7 lesser gnu lesser general public licen[sc]e
lgpl 50 .7 library gnu library general public licen[sc]e
lgpl 45 .7 lgpl (?:gnu )?lgpl(?: licen[sc]ed?)?
agpl-3 85 .95 affero gnu affero general public licen[sc]e V3(?: 0)?
agpl-3 75 .9 spdx spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 70 .9 agpl agpl V3(?: 0)?
agpl-3 70 .9 agplv3 (?:gnu )?agplv3
agpl 50 .7 affero (?:gnu )?affero general public licen[sc]e
agpl 45 .7 agpl (?:gnu )?agpl
gfdl-1.3 75 .9 gnu gnu free documentation licen[sc]e V1 3
gfdl-1.2 75 .9 gnu gnu free documentation licen[sc]e V1 2
gfdl-1.1 75 .9 gnu gnu free documentation licen[sc]e V1 1
gfdl 50 .7 gnu gnu free documentation licen[sc]e
gfdl 45 .7 gfdl gfdl
mpl-2 85 .95 mozilla (?:licensed under |subject to the terms of )(?:the )?mozilla public licen[sc]e V2(?: 0)?
mpl-2 80 .95 mozilla mozilla public licen[sc]e V2(?: 0)?
mpl-2 75 .9 spdx spdx license identifier mpl 2 0
mpl-2 70 .9 mpl mpl V2(?: 0)?
mpl-2 60 .8 mozilla mozilla org (?:en us )?mpl 2 0
mpl-1.1 80 .95 mozilla mozilla public licen[sc]e V1 1
mpl-1.1 75 .9 spdx spdx license identifier mpl 1 1
mpl-1.1 70 .9 mpl mpl V1 1
mpl-1.0 75 .9 mozilla mozilla public licen[sc]e V1 0
mpl 45 .7 mozilla mozilla public licen[sc]e
epl-2 80 .95 eclipse eclipse public licen[sc]e V2(?: 0)?
epl-2 75 .9 spdx spdx license identifier epl 2 0
epl-2 70 .9 epl epl V2(?: 0)?
epl-1 80 .95 eclipse eclipse public licen[sc]e V1(?: 0)?
epl-1 75 .9 spdx spdx license identifier epl 1 0
epl-1 70 .9 epl epl V1(?: 0)?
epl 45 .7 eclipse eclipse public licen[sc]e
edl-1 60 .8 eclipse eclipse distribution licen[sc]e(?: V1(?: 0)?)?
cpl-1 70 .9 common common public licen[sc]e(?: V1(?: 0)?)?
ipl-1 70 .9 ibm ibm public licen[sc]e(?: V1(?: 0)?)?
cddl-1.1 75 .9 cddl cddl V1 1
cddl-1.0 75 .9 cddl cddl V1 0
cddl-1.0 75 .9 distribution common development and distribution licen[sc]e V1 0
cddl-1.1 75 .9 distribution common development and distribution licen[sc]e V1 1
cddl 45 .7 distribution common development and distribution licen[sc]e
eupl-1.2 75 .9 eupl eupl V1 2
eupl-1.1 75 .9 eupl eupl V1 1
eupl-1.2 75 .9 union european union public licen[sc]e V1 2
eupl-1.1 75 .9 union european union public licen[sc]e V1 1
eupl 45 .7 union european union public licen[sc]e
cecill-2.1 75 .9 cecill cecill (?:free software license agreement )?V2 1
cecill-b 75 .9 cecill cecill b
cecill-c 75 .9 cecill cecill c
cecill 45 .7 cecill cecill
artistic-2 80 .95 artistic artistic licen[sc]e V2(?: 0)?
artistic-1 80 .95 artistic artistic licen[sc]e V1(?: 0)?
artistic-2 75 .9 spdx spdx license identifier artistic 2 0
artistic 45 .7 artistic (?:perl )?artistic licen[sc]e
perl 60 .8 perl (?:same terms as|under the terms of) perl(?: itself)?
python-2 70 .9 python|psf (?:python software foundation|psf) licen[sc]e(?: V2(?: 0)?)?
python 45 .7 python python licen[sc]e
php-3.01 70 .9 php php licen[sc]e V3 (?:01|0 1)
php 45 .7 php php licen[sc]e
ruby 45 .7 ruby ruby licen[sc]e
zlib 75 .9 spdx spdx license identifier zlib
zlib 60 .8 zlib zlib(?: libpng)? licen[sc]e
zlib 60 .85 warranty this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng 60 .8 libpng libpng licen[sc]e
boost-1 80 .95 boost boost software licen[sc]e(?: V1(?: 0)?)?
boost-1 75 .9 spdx spdx license identifier bsl 1 0
boost-1 60 .8 boost boost org license 1 0
bsl-1.1 75 .9 business business source licen[sc]e(?: V1 1)?
sspl-1 75 .9 sspl sspl(?: V1(?: 0)?)?
sspl-1 75 .9 server server side public licen[sc]e(?: V1(?: 0)?)?
elastic-2 75 .9 elastic elastic licen[sc]e V2(?: 0)?
elastic 45 .7 elastic elastic licen[sc]e
unlicense 80 .95 unlicense (?:spdx license identifier )?(?:the )?unlicense
unlicense 75 .9 unencumbered this is free and unencumbered software released into the public domain
wtfpl 75 .9 wtfpl wtfpl(?: V2(?: 0)?)?
wtfpl 75 .9 fuck do what the fuck you want to public licen[sc]e
beerware 60 .8 beerware beerware(?: licen[sc]e)?
beerware 60 .8 beer beer ware licen[sc]e
upl-1 70 .9 permissive universal permissive licen[sc]e(?: upl)?(?: V1(?: 0)?)?
ncsa 60 .8 ncsa (?:university of illinois )?(?:ncsa )?(?:open source )?ncsa(?: open source)? licen[sc]e
postgresql 60 .8 postgresql postgresql licen[sc]e
openssl 60 .8 openssl openssl licen[sc]e
sleepycat 60 .8 sleepycat sleepycat licen[sc]e
curl 60 .8 curl curl licen[sc]e
vim 60 .8 vim vim licen[sc]e
w3c 60 .8 w3c w3c (?:software (?:notice and )?)?licen[sc]e
ofl-1.1 80 .95 sil sil open font licen[sc]e(?: V1 1)?
ofl-1.1 75 .9 spdx spdx license identifier ofl 1 1
ofl-1.1 60 .8 ofl ofl V1 1
ms-pl 70 .9 microsoft microsoft public licen[sc]e
ms-rl 70 .9 microsoft microsoft reciprocal licen[sc]e
ms-eula 50 .7 microsoft microsoft software license terms
osl-3 70 .9 open open software licen[sc]e V3(?: 0)?
afl-3 70 .9 academic academic free licen[sc]e V3(?: 0)?
rpl-1.5 70 .9 reciprocal reciprocal public licen[sc]e(?: V1 5)?
qpl-1 60 .8 qpl|q (?:q public license|qpl)(?: V1(?: 0)?)?
lppl-1.3 70 .9 latex latex project public licen[sc]e(?: V1 3c?)?
mulan-2 70 .9 mulan mulan (?:psl|permissive software licen[sc]e)(?: V2)?
blue-oak-1 70 .9 oak blue oak model licen[sc]e(?: V?1(?: 0 0)?)?
odbl-1 75 .9 odbl odbl(?: V1(?: 0)?)?
odbl-1 75 .9 database open (?:data commons open )?database licen[sc]e(?: V1(?: 0)?)?
odc-by-1 75 .9 commons open data commons attribution licen[sc]e(?: V1(?: 0)?)?
pddl-1 75 .9 commons open data commons public domain dedication(?: and licen[sc]e)?
cdla-permissive 70 .9 cdla cdla permissive(?: V?[12](?: 0)?)?
cdla-sharing 70 .9 cdla cdla sharing(?: V?1(?: 0)?)?
cdla 50 .7 community community data licen[sc]e agreement
ogl-uk-3 70 .9 government open government licen[sc]e V3(?: 0)?
ogl 45 .7 government open government licen[sc]e
openrail 70 .9 openrail (?:creativeml |bigscience )?openrail(?: [mds]+)?(?: licen[sc]e)?
llama 60 .8 llama llama [0-9](?: [0-9])? community licen[sc]e
cc0-1 85 .95 cc0 (?:licensed under )?cc0(?: 1 0)?(?: universal)?
cc0-1 85 .95 creative creative commons zero(?: V1 0)?
cc0-1 60 .8 creativecommons creativecommons org publicdomain zero 1 0
cc-pdm 60 .8 creativecommons creativecommons org publicdomain mark 1 0
cc-by-nc-nd 90 .95 cc (?:licensed under )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa 90 .95 cc (?:licensed under )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?
cc-by-nc 85 .95 cc (?:licensed under )?(?:creative commons )?cc by nc(?: [1-4] [05])?
cc-by-nd 85 .95 cc (?:licensed under )?(?:creative commons )?cc by nd(?: [1-4] [05])?
cc-by-sa 85 .95 cc (?:licensed under )?(?:creative commons )?cc by sa(?: [1-4] [05])?
cc-by 80 .9 cc (?:licensed under )?(?:creative commons )?cc by(?: [1-4] [05])?
cc-by-nc-nd 88 .95 commons creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-sa 88 .95 commons creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc 83 .95 commons creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nd 83 .95 commons creative commons attribution no ?deriv(?:ative|atives|s)(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-sa 83 .95 commons creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by 78 .9 commons creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-nd 82 .9 creativecommons creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa 82 .9 creativecommons creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc 80 .9 creativecommons creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd 80 .9 creativecommons creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa 80 .9 creativecommons creativecommons org licenses by sa(?: [1-4] [05])?
cc-by 76 .9 creativecommons creativecommons org licenses by(?: [1-4] [05])?
cc-sampling 60 .8 commons creative commons sampling(?: plus)?
creative-commons 30 .5 commons (?:under )?(?:a )?creative commons(?: licen[sc]e)?
public-domain 60 .8 domain (?:released|dedicated|placed) (?:in)?to the public domain
public-domain 55 .8 domain (?:is|are) in the public domain
public-domain 40 .6 domain public domain
all-rights-reserved 40 .6 reserved all rights reserved
proprietary 60 .8 proprietary proprietary (?:and confidential|licen[sc]e)
proprietary 55 .8 confidential confidential and proprietary
proprietary 55 .8 unauthorized unauthorized (?:copying|use|reproduction) (?:\S+ ){0,12}(?:strictly )?prohibited
commercial 50 .7 commercial commercial licen[sc]e
non-commercial 45 .7 commercial (?:for )?non commercial (?:use|purposes)(?: only)?
non-commercial 45 .7 noncommercial (?:for )?noncommercial (?:use|purposes)(?: only)?
research-only 45 .7 research (?:for )?(?:academic )?research (?:use|purposes) only
educational 40 .6 educational (?:for )?educational (?:use|purposes) only
eula 50 .7 eula|agreement end user license agreement(?: eula)?|eula
eula 50 .7 agreement end user licen[sc]e agreement
shareware 45 .7 shareware (?:is )?shareware
freeware 45 .7 freeware (?:is )?freeware
copyleft 35 .5 copyleft copyleft
unknown-reference 20 .3 license|licence see (?:the )?(?:accompanying )?licen[sc]e(?: file| txt| md)?
unknown-reference 20 .3 license|licence licensed under (?:the )?(?:terms of the )?\S+ licen[sc]e
unknown-reference 15 .3 licensed (?:this work is )?licensed under
"""
VERSION = r"(?:version |v ?)?"

_DETECTION = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("rule", pa.int64())])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections array<struct<label:string,start:long,end:long,score:double,rule:long>>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("detections", pa.list_(_DETECTION))])
#: Lower-cases A-Z and turns every other ASCII byte that is not a letter or digit into a space; bytes from 0x80 on are of words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@cache
def rules() -> tuple[dict[bytes, list[tuple]], list[tuple]]:
    """Rules by keyword, and the base phrases, compiled."""
    bounded = lambda x: re.compile(b"(?:^|(?<= ))(?:" + x.encode() + b")(?= |$)")
    by_word: dict[bytes, list[tuple]] = {}
    for number, line in enumerate(RULES.strip().split("\n")):
        label, priority, score, keyword, pattern = line.split(" ", 4)
        rule = (number, int(priority), float(score), label, bounded(re.sub(r"(?<=[ (?])V(?=\??[0-9[])", VERSION.replace("\\", r"\\"), pattern)))
        for word in keyword.split("|"):
            by_word.setdefault(word.encode(), []).append(rule)
    return by_word, [(phrase.split()[-1].encode() if label == "mit" else phrase.split()[0].encode(), label, len(phrase.split()), bounded(phrase)) for phrase, label in BASE]


def uncovered(found: list[tuple[int, int]]) -> Iterator[int]:
    """Of (start, end) in falling rank the positions of those that lie inside no earlier one that was kept.

    For each start the farthest end of all kept that begin no later comes from a tree of maxima, so time is n log n.
    """
    rank = {start: k + 1 for k, start in enumerate(sorted({start for start, _ in found}))}
    reach = [-1] * (len(rank) + 1)
    for position, (start, end) in enumerate(found):
        k, farthest = rank[start], -1
        while k:
            farthest, k = max(farthest, reach[k]), k & (k - 1)
        if farthest < end:
            yield position
            k = rank[start]
            while k < len(reach):
                reach[k] = max(reach[k], end)
                k += k & -k


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, detections) of one text."""
    by_word, base = rules()
    words = text.encode().translate(_WORDS).split()
    present = by_word.keys() & set(words) if len(words) < 64 else by_word.keys() & words
    if not present:
        return len(words), 0, None, None, [], []
    line = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    at = lambda char: int(spaces.searchsorted(char))
    places, labels, found = [], set(), []
    for keyword, label, _, pattern in base:
        if keyword in present:
            got = [at(m.start()) for m in pattern.finditer(line)]
            places += got
            if got:
                labels.add(label)
    for number, priority, score, label, pattern in {rule[0]: rule for keyword in present for rule in by_word[keyword]}.values():
        found += [(-priority, m.start() - m.end(), m.start(), number, m.end(), label, score) for m in pattern.finditer(line)]
    found.sort()
    kept = (found[k] for k in uncovered([(start, end) for _, _, start, _, end, _, _ in found]))
    taken = [(start, end, label, score, number) for _, _, start, number, end, label, score in kept]
    detections = [{"label": label, "start": at(a), "end": at(b) + 1, "score": score, "rule": number} for a, b, label, score, number in sorted(taken)]
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), detections


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: base counts and the detections that were not suppressed, their intervals in words."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(scan(t) for t in batch.column(1).to_pylist()), strict=True))
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(got, _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)

    return texts(docs, text, doc_id).mapInArrow(run, SCHEMA)
