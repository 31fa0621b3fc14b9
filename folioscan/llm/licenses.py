"""License scan by an exact set-similarity join of text blocks with license templates.

Templates are short notices and whole license texts. A block is a run of BLOCK_WORDS words, or for a longer template of
the power of two that holds it twice; it goes across line ends, and each block overlaps the next by half, so every notice
stands whole in some block. A template joins a block of its size if the block holds at least THRESHOLD of the template's
distinct words. Tokens are ordered by how many documents of the whole corpus hold them, rarest first. Prefix filter: a
block that misses every one of a template's first size - needed + 1 tokens cannot reach it. Length filter: nor can a
block of fewer than needed words. Positional filter: while the tokens are walked in order, a pair is dropped once those
left cannot make up what is missing. Base labels come from phrases whose words stand consecutively.

Scale. One pass counts the templates' tokens (a fixed vocabulary, summed per task before anything is sent), one pass
joins; texts are not shuffled. The templates are fixed values of a few KB, sent with the task.

Cases. Null, empty or wordless text: no words, no places, no labels, score 0. Null doc_id: a row like any other. Repeated rows:
each is a row of the result. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import WORDS_TABLE, chunks, doc_rows
from folioscan.llm.license_texts import TEXTS

THRESHOLD = 0.9
BLOCK_WORDS = 64

# Phrases of the base scan, and templates of common license notices with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under cc by 4 0 international": "cc-by",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}


TEMPLATES |= {" ".join(text.encode().translate(WORDS_TABLE).decode().split()): label for text, label in TEXTS.items()}


class Index:
    """Templates with their tokens in global order, and which prefix token leads to which template."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.threshold = threshold
        self.templates = []
        self.prefix: dict[bytes, list[int]] = {}
        for text, label in templates.items():
            tokens = sorted(set(text.encode().split()), key=lambda t: (frequency.get(t, 0), t))
            needed = math.ceil(threshold * len(tokens) - 1e-9)
            for t in tokens[: len(tokens) - needed + 1]:
                self.prefix.setdefault(t, []).append(len(self.templates))
            self.templates.append((tokens, needed, label))

    def join(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that the block holds enough of."""
        for k in {k for t in self.prefix.keys() & block for k in self.prefix[t]}:
            tokens, needed, label = self.templates[k]
            if len(block) < needed:
                continue
            shared = 0
            for at, t in enumerate(tokens):
                shared += t in block
                if shared + len(tokens) - at - 1 < needed:
                    break
            else:
                yield label, shared / len(tokens)


def token_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each token of a vocabulary of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(vocabulary.intersection(text.translate(WORDS_TABLE).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in counts.collect()}


def block_size(template: str, least: int = BLOCK_WORDS) -> int:
    """Words of the blocks in which a template is looked for."""
    return max(least, 2 << (len(template.split()) - 1).bit_length())


def _blocks(words: list[bytes], size: int) -> Iterator[set[bytes]]:
    for at in range(0, max(1, len(words) - size // 2), size // 2):
        yield set(words[at : at + size])


def _phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase begins; joined has a space before and after every word."""
    out, at = [], joined.find(phrase)
    while at >= 0:
        out.append(joined.count(b" ", 0, at))
        at = joined.find(phrase, at + 1)
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): score is the best containment of a template, 1 with a base place, else 0."""
    rows = doc_rows(docs, id_col, text_col)
    vocabulary = {t for text in templates for t in text.encode().split()}
    frequency = token_counts(rows, vocabulary)
    of_size: dict[int, dict[str, str]] = {}
    for text, label in templates.items():
        of_size.setdefault(block_size(text, block_words), {})[text] = label
    indexes = [(size, Index(own, frequency, threshold)) for size, own in of_size.items()]
    sought = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def scan(text: bytes) -> tuple:
        words = text.translate(WORDS_TABLE).split()
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in sought:
            if found := _phrase_places(joined, phrase):
                places += found
                base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        for size, index in indexes:
            if not index.prefix.keys().isdisjoint(words):
                for block in _blocks(words, size):
                    for label, share in index.join(block):
                        labels.add(label)
                        score = max(score, share)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for batch in batches:
            for c in chunks(batch):
                found = [scan(t) for t in c.column("text").to_pylist()]
                columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
