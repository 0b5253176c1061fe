"""License phrases in documents: exact ones, and short notices with a few edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.llm.decontam import normalise

#: Phrases that must stand word for word, and short notices that may differ in a few characters.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "all rights reserved by the": "notice-reserved",
    "licensed under a creative commons attribution": "notice-creative-commons",
    "licensed under cc by nc 4 0": "notice-cc-by-nc",
    "licensed under the apache license version 2 0": "notice-apache",
    "licensed under the gnu general public license": "notice-gpl",
    "permission is hereby granted free of charge": "notice-mit",
    "redistribution and use in source and binary forms": "notice-bsd",
    "released under the mit license": "notice-mit",
    "subject to the terms of the mozilla public license": "notice-mpl",
    "this work is dedicated to the public domain": "notice-public-domain",
}
#: Characters of a notice for each edit that it may have.
CHARACTERS_AN_EDIT = 12


class Search:
    """One automaton over the phrases and the seeds of the notices.

    A notice with up to k edits is cut into k+1 parts: one of them at least stands unchanged in any text that has the
    notice, so only the surroundings of a part's places are matched with a bounded number of errors.
    """

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]) -> None:
        self.found = ahocorasick.Automaton()
        self.notices = []
        entries: dict[str, list[tuple]] = {}
        for phrase, label in phrases.items():
            entries.setdefault(f" {phrase} ", []).append((None, 0, label))
        for i, (notice, label) in enumerate(notices.items()):
            k = max(1, len(notice) // CHARACTERS_AN_EDIT)
            self.notices.append((label, len(notice), k, regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={k}}}")))
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                entries.setdefault(notice[a:b], []).append((i, a, ""))
        for seed, owners in entries.items():
            self.found.add_word(seed, (len(seed), owners))
        self.found.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, float]]]:
        """(words, (start word, label) of every phrase, (label, start, end, edits, similarity) of every notice; bytes of the normalised text)."""
        text, n = normalise(raw)
        phrases: list[tuple[int, str]] = []
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.found.iter(text):
            at = end - size + 1
            for i, offset, label in owners:
                if i is None:
                    phrases.append((at, label))
                else:
                    _, length, k, _ = self.notices[i]
                    lo, hi = max(0, at - offset - k), min(len(text), at - offset + length + k)
                    held = near.setdefault(i, [])
                    if held and lo <= held[-1][1]:
                        held[-1] = min(held[-1][0], lo), max(held[-1][1], hi)
                    else:
                        held.append((lo, hi))
        matches = []
        for i, places in near.items():
            label, length, _, pattern = self.notices[i]
            for lo, hi in places:
                for m in pattern.finditer(text, lo, hi):
                    edits = sum(m.fuzzy_counts)
                    matches.append((label, m.start(), m.end(), edits, 1 - edits / length))
        return n, phrases, sorted(matches, key=lambda m: (m[1], m[0]))


@cache
def _search() -> Search:
    return Search(PHRASES, NOTICES)


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans per row of ``docs``.

    The words of PHRASES must follow each other; every place counts in n_base, first_word and last_word are the
    smallest and largest word at which one begins (null without any). NOTICES may have an edit (a changed, missing or
    additional byte of the normalised text) for every CHARACTERS_AN_EDIT of them; spans gives each match's label, byte
    offsets in the original text and edits. labels has both kinds, sorted; score is 1 where a phrase stands, else the
    greatest similarity of a notice, else 0. Null and empty texts have no words; repeated rows have equal results.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search()
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                n, phrases, notices = search.scan(raw)
                first = last = None
                spans = []
                if phrases or notices:
                    blanks = np.flatnonzero(np.frombuffer(normalise(raw)[0].encode("latin-1"), np.uint8) == 32)
                    if phrases:
                        starts = np.searchsorted(blanks, [at for at, _ in phrases])
                        first, last = int(starts.min()), int(starts.max())
                    if notices:
                        data = np.frombuffer(raw, np.uint8)
                        start, end, _ = tx.spans(data, np.array([0, len(data)]), tx.ALNUM)
                        for label, a, b, edits, _ in notices:
                            words = np.searchsorted(blanks, [a, b - 1], "right") - 1
                            lo, hi = min(int(words[0]), n - 1), min(int(words[1]), n - 1)
                            spans.append({"label": label, "start": int(start[lo]), "stop": int(end[hi]), "edits": edits})
                base = sorted({x for _, x in phrases})
                score = 1.0 if phrases else max((m[4] for m in notices), default=0.0)
                rows.append((n, len(phrases), first, last, ",".join(base), ",".join(sorted({*base, *(m[0] for m in notices)})), score, spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64())]))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    out = rows.mapInArrow(run, f"key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, start: bigint, stop: bigint, edits: bigint>>")
    return out.withColumnRenamed("key", key) if key != "key" else out
