"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a
seed. A letter n-gram binds its letters' vectors, each permuted (rotated) once
for every place it stands from the end, by their product. A text's profile
bundles (sums) the vectors of all its n-grams; a language's prototype bundles
those of all its training texts. Texts and prototypes are compared by cosine.

Words are runs of letters, lower-cased, with one boundary symbol on either side,
so every word has an n-gram. Counting n-grams is all that reads the texts;
prototypes are sums of n-gram vectors weighted by corpus counts, made by the
tasks that hold the counts and added up by Spark. What comes to the driver is
one vector of ``dim`` numbers for each language; more than ``most_languages`` of
them is an error.

Defined cases: a null text and one without a letter are ``und`` with score 0, as
is every text when nothing was learned; equal scores go to the smaller name;
null labels are not learned from; equal rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table, remainder_is

UNKNOWN = "und"
#: Prototypes' dimension, and the likeness that unrelated vectors of it seldom pass: three standard deviations of chance.
DIM = 1024
NOISE = 3 / DIM**0.5
#: A text of fewer distinct n-grams may be in a learned language and yet be no liker to it than chance.
FEW_GRAMS = 20
#: Texts are folded to letter codes in blocks of about this many characters.
BLOCK_CHARS = 1 << 20
#: Stands between texts that are counted together: no n-gram reaches over it (a private code point, no letter).
MARK = 0xE000
#: n-grams whose vectors are held ready in a task.
HELD_GRAMS = 1 << 15


class Letters:
    """Lower-cased letters of texts, and their random vectors."""

    def __init__(self, dim: int, seed: int, size: int) -> None:
        self.dim, self.seed, self.size = dim, seed, size
        self.known = np.full(0x110000, -1, np.int32)  # code point -> lower-case letter, 0 for what is no letter
        self.known[MARK] = MARK
        self.vectors: dict[tuple[int, int], np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}

    def folded(self, text: str) -> np.ndarray:
        """Code points, lower-cased, 0 for what is no letter; a 0 before and after."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        out = self.known[points]
        if (new := np.unique(points[out < 0])).size:
            for p in new.tolist():
                c = chr(p).lower()
                self.known[p] = ord(c[0]) if c[0].isalpha() else 0
            out = self.known[points]
        return np.concatenate([[0], out, [0]])

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """n-grams as 21-bit places in a 64-bit number, and how often each occurs."""
        code = self.folded(text).astype(np.int64)
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]  # one boundary between words
        if len(code) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        code = np.concatenate([np.zeros(max(0, self.size - len(code)), np.int64), code])
        gram = code[: len(code) - self.size + 1].copy()
        for i in range(1, self.size):
            gram = gram << 21 | code[i : len(code) - self.size + 1 + i]
        if (code == MARK).any():  # none that reaches over a mark
            gram = gram[np.all([gram >> 21 * i & 0x1FFFFF != MARK for i in range(self.size)], 0)]
        return np.unique(gram, return_counts=True)

    def vector(self, letter: int, turns: int) -> np.ndarray:
        if (letter, turns) not in self.vectors:
            drawn = np.random.default_rng([self.seed, letter]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            self.vectors[letter, turns] = np.roll(drawn, turns).astype(np.float32)
        return self.vectors[letter, turns]

    def gram(self, code: int) -> np.ndarray:
        """Permuted letters, bound."""
        found = self.grams.get(code)
        if found is None:
            found = np.ones(self.dim, np.float32)
            for turns in range(self.size):
                found = found * self.vector(code >> 21 * turns & 0x1FFFFF, turns)
            if len(self.grams) >= HELD_GRAMS:
                self.grams.clear()
            self.grams[code] = found
        return found

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weighted sum of n-gram vectors."""
        out = np.zeros(self.dim, np.float64)
        for at in range(0, len(grams), 4096):
            out += counts[at : at + 4096].astype(np.float32) @ np.stack([self.gram(g) for g in grams[at : at + 4096].tolist()])
        return out


class Table:
    """n-gram vectors of a task as rows of one matrix, so that a text's bundle is one product."""

    def __init__(self, letters: Letters) -> None:
        self.letters = letters
        self.rows = np.empty((0, letters.dim), np.int8)
        self.place: dict[int, int] = {}

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        place, keys = self.place, grams.tolist()
        new = [g for g in keys if g not in place]
        if len(place) + len(new) > HELD_GRAMS:
            place.clear()
            self.rows = self.rows[:0]
            new = keys
        if len(new) > HELD_GRAMS:
            return self.letters.bundle(grams, counts)
        if new:
            need = len(place) + len(new)
            if need > len(self.rows):
                grown = np.empty((min(HELD_GRAMS, max(2 * need, 1024)), self.letters.dim), np.int8)
                grown[: len(place)] = self.rows[: len(place)]
                self.rows = grown
            for g in new:
                self.rows[len(place)] = self.letters.gram(g)
                place[g] = len(place)
        at = [place[g] for g in keys]
        out = np.zeros(self.letters.dim, np.float64)
        for k in range(0, len(at), 2048):
            out += counts[k : k + 2048].astype(np.float32) @ self.rows[at[k : k + 2048]].astype(np.float32)
        return out


def gram_counts(docs: DataFrame, *, size: int) -> DataFrame:
    """(lang, gram, n) over rows (lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(1, 0, size)
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                at = 0
                while at < len(own):  # whole texts, some at a time
                    to, chars = at, 0
                    while to < len(own) and (to == at or chars + len(own[to]) <= BLOCK_CHARS):
                        chars += len(own[to])
                        to += 1
                    grams, counts = letters.counts(f"\n{chr(MARK)}\n".join(own[at:to]))
                    yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
                    at = to

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, size: int = 3, seed: int = 11, most_languages: int = 2000) -> dict[str, np.ndarray]:
    """The unit prototype of every language of the labelled rows."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dim, seed, size), {}
        for batch in batches:
            langs, grams, counts = (np.array(c.to_pylist()) for c in batch.columns)
            for lang in set(langs.tolist()):
                own = langs == lang
                sums[lang] = sums.get(lang, 0) + letters.bundle(grams[own], counts[own])
        yield pa.record_batch(
            [pa.array([k for k in sums for _ in range(dim)], pa.string()), pa.array(list(range(dim)) * len(sums), pa.int32()), pa.array(np.concatenate([*sums.values()]) if sums else [], pa.float64())], names=["lang", "at", "x"]
        )

    parts = gram_counts(rows, size=size).mapInArrow(run, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).limit(most_languages + 1).collect()
    if len(vectors) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    out = {r.lang: np.array([e.x for e in r.v]) for r in sorted(vectors)}
    return {lang: v / norm for lang, v in out.items() if (norm := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str | Column = "doc_id", text_col: str = "text", size: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, lang_pred, score, margin, grams): the nearest prototype, its cosine (0 if negative), the lead over the second, and the text's distinct n-grams."""
    names = sorted(prototypes)
    dim = len(prototypes[names[0]]) if names else 1
    sent = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dim))
    key = F.col(id_col) if isinstance(id_col, str) else id_col

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(Letters(dim, seed, size))
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                grams, counts = table.letters.counts(text or "")
                if not len(grams) or not names:
                    found.append((UNKNOWN, 0.0, 0.0, len(grams)))
                    continue
                profile = table.bundle(grams, counts)
                cosines = sent @ profile / (np.linalg.norm(profile) or 1.0)
                best = int(np.argmax(cosines))
                second = float(np.delete(cosines, best).max(initial=0.0))
                score = min(1.0, max(0.0, float(cosines[best])))
                found.append((names[best], score, max(0.0, score - second), len(grams)))
            cols = zip(*found) if found else ((), (), (), ())
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.int64())))], names=["doc_id", "lang_pred", "score", "margin", "grams"])

    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, keyed("doc_id", rows.schema[0].dataType, "lang_pred string, score double, margin double, grams long"))


def understood() -> Column:
    """True for a row of ``identify`` that is in a learned language: it has letters, and more than chance in common with one if it has n-grams enough to tell."""
    return (F.col("lang_pred") != UNKNOWN) & ((F.col("grams") < FEW_GRAMS) | (F.col("score") > NOISE))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, lang_pred, score, margin; learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = remainder_is("doc_id", 4, 2)
    found = identify(docs, learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin")
