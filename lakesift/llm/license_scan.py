"""License scans (9): a positional rare-token index. Of each licence template the words are indexed with their positions; document frequencies over the
whole table say which of them are rare. A file's licence words of highest IDF are looked up, the postings of a template are
intersected by relative position (template position less file position), and the template's mandatory key phrases are then verified.

Templates are of two kinds. Whole licence texts (licences/, by SPDX identifier): the rarest word of every SEGMENT tokens is an anchor; each occurrence of an anchor's word in a file, less the anchor's
position, says where the text would begin, and a text is found at a place p where MIN_SHARE of its anchors or more say p to p + drift (drift: SLACK and a tenth of its length), if its mandatory
phrases are whole between p - drift and p + length + drift. A file with so many anchors has one of any (anchors - needed + 1), so those of highest IDF are looked up and nothing is lost. Further
places of the same text begin after the end of the one before.

Notices are phrases: a notice is found at a place if each of its key phrases is there, whole, at its relative position give or take SLACK tokens, counted from the first phrase; at a "..." any number of tokens may stand. The look-up loses
nothing: its key phrases are indexed by their rarest word, and a file with it has that word for each phrase. The first phrase's rarest word
gives the place; the others must have postings near the place that it predicts; only then are words compared.

Two passes: the first counts in how many files each licence word is (a few hundred words, summed before the shuffle), the second looks up and verifies. The
index is of constant size and is sent to the tasks.

Defined cases: a null or empty text has no licence. A text that holds a licence many times has a row for it once, at its first place, with the number of places. Two templates
that share words are each found where their phrases are; where one's phrases include another's at the same place (Apache in a header), both are rows. A short Creative Commons form
counts as the longest one at its place ("CC BY-NC 4.0" is no CC BY). A text that another includes (BSD-2-Clause in BSD-3-Clause) is found too. Rows that repeat are scanned alike. An empty table gives an empty one. Extra
columns, apart from the id, aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.llm.common import lowered, pieces, token_hashes

SLACK = 12
#: Licence, version -> phrases in the order in which the notice has them; "..." stands for words that may differ between files.
TEMPLATES = {
    "MIT": ("permission is hereby granted free of charge to any person obtaining a copy", "...", "the software is provided as is without warranty of any kind"),
    "MIT-notice": ("under the mit license",),
    "Apache-2.0": ("licensed under the apache license version 2 0",),
    "GPL-2.0": ("gnu general public license", "version 2"),
    "GPL-3.0": ("gnu general public license", "version 3"),
    "LGPL": ("gnu lesser general public license",),
    "AGPL-3.0": ("gnu affero general public license",),
    "MPL-2.0": ("mozilla public license", "2 0"),
    "BSD": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "BSD-notice": ("under the bsd license",),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "CC-BY": ("creative commons attribution",),
    "CC-BY-SA": ("creative commons attribution", "share alike"),
    "CC0": ("creative commons zero",),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "EPL": ("eclipse public license",),
    "WTFPL": ("do what the fuck you want to public license",),
    "proprietary": ("all rights reserved",),
}
#: Creative Commons licences in short, as notices and SPDX identifiers have them ("CC BY-NC 4.0", "CC-BY-NC-4.0"), by version.
CC_FORMS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 1", "2 5", "3 0", "4 0")
TEMPLATES |= {f"CC-{f.upper().replace(' ', '-')}-{v.replace(' ', '.')}": (f"cc {f} {v}",) for f in CC_FORMS for v in CC_VERSIONS} | {"CC0-1.0": ("cc0 1 0",)}
#: Other SPDX identifiers; those that are common words or short names count after the tag only.
TEMPLATES |= {f"{x}-id": (x.lower().replace("-", " ").replace(".", " "),) for x in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "EPL-1.0", "EPL-2.0")}
TEMPLATES |= {f"{x}-id": (f"spdx license identifier {x.lower()}",) for x in ("MIT", "ISC", "Unlicense", "WTFPL")}
#: Short forms without a version: a longer form at the same place isn't one.
UNVERSIONED = {f"CC-{f.upper().replace(' ', '-')}": f"cc {f}" for f in CC_FORMS} | {"CC0": "cc0"}
#: Tokens to an anchor; the share of anchors that must agree on a place.
SEGMENT, MIN_SHARE = 25, 0.8
#: Whole texts and their mandatory phrases.
PHRASES = {
    "Apache-2.0": ("apache license version 2 0 january 2004", "terms and conditions for use reproduction and distribution"), "Artistic-1.0": ("the artistic license",), "CC0-1.0": ("creative commons legal code", "affirmer"),
    "BSD-2-Clause": ("redistribution and use in source and binary forms",), "BSD-3-Clause": ("redistribution and use in source and binary forms", "may be used to endorse or promote products"), "GFDL-1.3": ("gnu free documentation license", "version 1 3"),
    "GPL-2.0": ("gnu general public license", "version 2 june 1991"), "GPL-3.0": ("gnu general public license", "version 3 29 june 2007"), "LGPL-2.1": ("gnu lesser general public license", "version 2 1 february 1999"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3 29 june 2007"), "ISC": ("permission to use copy modify and or distribute this software",), "MIT": ("permission is hereby granted free of charge", "sublicense"),
    "MPL-1.1": ("mozilla public license", "version 1 1"), "MPL-2.0": ("mozilla public license version 2 0",), "Unlicense": ("this is free and unencumbered software",), "Zlib": ("this software is provided as is", "altered source versions must be plainly marked"),
}
_ANY = 1 << 60


def texts() -> dict[str, tuple[str, tuple[str, ...]]]:
    """The whole texts, with their phrases."""
    folder = Path(__file__).resolve().parent / "licences"
    return {name: ((folder / f"{name}.txt").read_text(encoding="utf-8"), keys) for name, keys in PHRASES.items()}


def whole_text(name: str, text: str, keys: tuple[str, ...], counts: dict[int, int]) -> tuple:
    """(name, length, anchors' words, their positions, mandatory phrases, the words to look up)."""
    own = token_hashes(lowered(pa.array([text], pa.large_string())))[0]
    often = [counts.get(int(h), 0) for h in own]
    at = np.array([min(range(k, min(k + SEGMENT, len(own))), key=lambda i: (often[i], i)) for k in range(0, len(own), SEGMENT)])
    needed = int(np.ceil(MIN_SHARE * len(at)))
    rarest = sorted(at, key=lambda i: (often[i], i))[: len(at) - needed + 1]
    return name, len(own), own[at], at, [_key(k.split()) for k in keys], np.unique(own[rarest])


def find_text(hashes: np.ndarray, plan: tuple) -> list[int]:
    """Places of a whole text in a file's token hashes."""
    _, length, anchors, at, keys, _ = plan
    drift, needed = SLACK + length // 10, int(np.ceil(MIN_SHARE * len(at)))
    where = np.flatnonzero(np.isin(hashes, anchors))
    own = hashes[where]
    lists = [where[own == a] - p for a, p in zip(anchors, at)]
    if sum(map(bool, map(len, lists))) < needed:
        return []
    begin, which = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    by = np.argsort(begin, kind="stable")
    begin, which = begin[by], which[by]
    seen, distinct, end, out, free = np.zeros(len(lists), np.int64), 0, 0, [], -_ANY
    for k in range(len(begin)):
        while end < len(begin) and begin[end] <= begin[k] + drift:
            distinct += seen[which[end]] == 0
            seen[which[end]] += 1
            end += 1
        if distinct >= needed and begin[k] > free and all(_between(hashes, p, begin[k] - drift, begin[k] + length + drift) for p in keys):
            out.append(max(0, int(begin[k])))
            free = begin[k] + length
        seen[which[k]] -= 1
        distinct -= seen[which[k]] == 0
    return out


def _between(hashes: np.ndarray, phrase: np.ndarray, lo: int, hi: int) -> bool:
    lo, hi = max(0, int(lo)), min(len(hashes) - len(phrase), int(hi))
    return hi >= lo and bool(_whole(hashes, lo + np.flatnonzero(hashes[lo : hi + 1] == phrase[0]), phrase).any())


def _key(words: list[str]) -> np.ndarray:
    return token_hashes(lowered(pa.array([" ".join(words)], pa.large_string())))[0]


def phrases(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[list[str]], list[tuple[int, int]]]]:
    """(name, phrases as words, for each phrase the least and greatest place relative to the first)."""
    out = []
    for name, parts in templates.items():
        found, at, lo, hi = [], [], 0, 0
        for p in parts:
            if p == "...":
                hi = _ANY
                continue
            found.append(p.split())
            at.append((lo, hi + (SLACK if at else 0)))
            lo, hi = lo + len(found[-1]), hi + len(found[-1])
        out.append((name, found, at))
    return out


def licence_words(docs: DataFrame, text: str, templates: dict, whole: dict) -> dict[int, int]:
    """In how many rows each word of the templates is, by the word's hash."""
    words = np.unique(np.concatenate([*(_key(p) for _, found, _ in phrases(templates) for p in found), *(_key([t]) for t, _ in whole.values())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(words), np.int64)
        for whole in batches:
            for batch in pieces(whole, text):
                hashes, firsts = token_hashes(lowered(batch.column(text)))
                spot = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                which = np.flatnonzero(words[spot] == hashes)
                row = np.searchsorted(firsts, which, "right") - 1
                pair = np.unique(row.astype(np.int64) * len(words) + spot[which])
                counts += np.bincount(pair % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["w", "n"])

    found = docs.select(text).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r.w).view(np.uint64)): r.n for r in found}


def find(hashes: np.ndarray, plan: list[tuple]) -> list[tuple[str, int, int]]:
    """(licence, first place, places) in a file's token hashes. plan: see scan."""
    out: dict[str, tuple[int, int]] = {}
    for name, parts, at, anchors, longer in plan:
        lists = []
        for p, a in zip(parts, anchors):
            places = np.flatnonzero(hashes == p[a]) - a  # where the phrase begins, by its rarest word
            places = places[(places >= 0) & (places + len(p) <= len(hashes))]
            lists.append(places)
            if not len(places):
                break
        if len(lists) < len(parts) or not all(map(len, lists)):
            continue
        place = lists[0]
        for more, (lo, hi) in zip(lists[1:], at[1:]):  # relative positions
            place = place[np.searchsorted(more, place + lo) < np.searchsorted(more, place + hi, "right")]
        place = place[_whole(hashes, place, parts[0])]
        for p, more, (lo, hi) in zip(parts[1:], lists[1:], at[1:]):
            more = more[_whole(hashes, more, p)]
            place = place[np.searchsorted(more, place + lo) < np.searchsorted(more, place + hi, "right")]
        for p in longer:
            fits = place + len(p) <= len(hashes)
            fits[fits] = _whole(hashes, place[fits], p)
            place = place[~fits]
        if len(place):
            first, n = out.get(name, (int(place[0]), 0))
            out[name] = min(first, int(place[0])), n + len(place)
    return [(name, *x) for name, x in out.items()]


def _whole(hashes: np.ndarray, places: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    ok = np.ones(len(places), np.bool_)
    for k, h in enumerate(phrase):
        ok &= hashes[places + k] == h
    return ok


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", templates: dict | None = None) -> DataFrame:
    """(id_col, license, first_token, n_places): a row for each licence found in a row of docs. A whole text's name ends in -text. With templates, these notices alone are sought."""
    short, full = (UNVERSIONED, texts()) if templates is None else ({}, {})
    templates = TEMPLATES if templates is None else templates
    counts = licence_words(docs, text, templates, full)
    plan, whole = [], [whole_text(f"{name}-text", *x, counts) for name, x in full.items()]
    for name, parts, at in [*phrases(templates), *phrases({k: (x,) for k, x in short.items()})]:
        keys = [_key(p) for p in parts]
        own = " ".join(parts[0])
        longer = [_key(x.split()) for (x, *_) in [*templates.values(), *((x,) for x in short.values())] if x.startswith(f"{own} ")] if short.get(name) == own else []
        plan.append((name, keys, at, [min(range(len(k)), key=lambda i: (counts.get(int(k[i]), 0), i)) for k in keys], longer))
    rarest = [min((k[a] for k, a in zip(keys, anchors)), key=lambda h: counts.get(int(h), 0)) for _, keys, _, anchors, _ in plan]
    of_word: dict[int, tuple[list, list]] = {}
    for k, looked_up in enumerate(([(r, p) for r, p in zip(rarest, plan)], [(w, p) for p in whole for w in p[5]])):
        for w, p in looked_up:
            of_word.setdefault(int(w), ([], []))[k].append(p)
    index = np.unique(np.array(list(of_word), np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                hashes, firsts = token_hashes(lowered(batch.column(text)))
                spot = np.minimum(np.searchsorted(index, hashes), len(index) - 1)
                which = np.flatnonzero(index[spot] == hashes)
                hits = np.unique((np.searchsorted(firsts, which, "right") - 1).astype(np.int64) * len(index) + spot[which])
                rows, found = [], []
                for row in np.unique(hits // len(index)) if len(hits) else ():
                    mine = hashes[firsts[row] : firsts[row + 1]]
                    here = [of_word[int(index[h % len(index)])] for h in hits[np.searchsorted(hits, row * len(index)) : np.searchsorted(hits, (row + 1) * len(index))]]
                    places = {p[0]: find_text(mine, p) for _, long in here for p in {x[0]: x for x in long}.values()}
                    for x in sorted([*find(mine, [p for notices, _ in here for p in notices]), *((name, at[0], len(at)) for name, at in places.items() if at)]):
                        rows.append(int(row))
                        found.append(x)
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows, pa.int64())), *columns], [id_col, "license", "first_token", "n_places"])

    kinds = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("first_token", T.LongType()), T.StructField("n_places", T.LongType())]
    return docs.select(id_col, text).mapInArrow(run, T.StructType(kinds))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
