"""Secret scan: known shapes, and strings that only a random source makes.

Known shapes (``BASE``) are found by pattern and always kept. Other candidates
are maximal runs of at least ``least`` encoding characters. For each, the
smallest encoding that holds it is inferred and three tests of randomness are
made over its alphabet: chi-squared uniformity (with the exact mean and variance
for short strings), the runs test about the alphabet's middle, and lag-one
serial correlation. Their p-values are combined (Bonferroni over the three). A
string that a random source of that encoding would make with probability under
``alpha`` is dropped; the encoding is read off the string itself, so that a random
string of few characters may be tried by a smaller one and is then dropped too
often rather than too seldom.

Ordinary text passes the battery now and then, the oftener the shorter it is. How
often is counted on the corpus: all text outside of candidates, its encoding
characters run together, is cut into strings as long as the least of each length
group, and the battery is made on each in the encoding it shows. The share of
those of a candidate's group and encoding that look at least as random is the
candidate's p-value as ordinary text. A second one comes from the corpus' own
first-order character model: the ratio of the string's probability under the
encoding to that under the model bounds the chance of an ordinary string looking
so random (Markov's inequality), and grows with length. Twice the smaller of both
is what counts.
Over all candidates of the corpus the Benjamini-Hochberg step-up rule on these
p-values keeps the share of false discoveries under ``fdr``, in each group of
strings of similar length. What travels to the driver is fixed in size: one
count for each character pair, one for each encoding, length group and step of
the battery, and one for each length group and step of evidence.

Offsets are code points, ends exclusive. A base span is the whole match. Defined cases: null is the empty
text; equal rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import keyed, read_table, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet up; the first that holds a string is its own.
ENCODINGS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36_upper", DIGITS + UPPER),
    ("letters", UPPER + LOWER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("any", UPPER + LOWER + DIGITS + "+/-_"),
)
_SETS = tuple(frozenset(a) for _, a in ENCODINGS)
#: Character classes of the corpus model: each encoding character, and 0 for all others.
CHARS = ENCODINGS[-1][1]
N_CHARS = len(CHARS) + 1
_CODE = np.zeros(256, np.uint16)
_CODE[np.frombuffer(CHARS.encode(), np.uint8)] = np.arange(1, N_CHARS)

#: The code of the first mark; all from it on are marks.
_MARKS = 1 + CHARS.index("+")

#: Evidence is counted in steps of 1/STEPS of a factor of ten, up to MOST tens.
STEPS, MOST = 8, 64
#: Length groups for the discovery control: powers of two.
GROUPS = 12
#: Lengths of the ordinary strings that stand for a group; longer groups are judged by the longest.
LENGTHS = {5: 20, 6: 32, 7: 64, 8: 128}
#: Characters by the encodings that they tell apart, one bit each.
_ATOMS = ("01", "234567", "89", "abcdef", LOWER[6:], "ABCDEF", UPPER[6:], "+/", "-_")
_BITS = np.zeros(N_CHARS, np.uint16)
for _i, _atom in enumerate(_ATOMS):
    _BITS[_CODE[np.frombuffer(_atom.encode(), np.uint8)]] = 1 << _i
_ENCODING = np.array([next(e for e, own in enumerate(_SETS) if all(own >= {*a} for i, a in enumerate(_ATOMS) if bits >> i & 1)) for bits in range(1 << len(_ATOMS))], np.int8)
#: A character's place in each alphabet.
_PLACE = np.array([[0, *(a.find(c) for c in CHARS)] for _, a in ENCODINGS])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the known shapes."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidate_pattern(least: int) -> re.Pattern[str]:
    return re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{least},}}={{0,2}}")


def encoding_of(token: str) -> int:
    seen = set(token)
    return next(i for i, s in enumerate(_SETS) if seen <= s)


def battery(token: str, encoding: int) -> float:
    """The probability that a random source of the encoding makes a string as odd as ``token``."""
    alphabet = ENCODINGS[encoding][1]
    size, n = len(alphabet), len(token)
    if n < 2:
        return 1.0
    at = [alphabet.index(c) for c in token]
    expected = n / size
    chi = sum((c - expected) ** 2 for c in Counter(at).values()) / expected + (size - len(set(at))) * expected
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = [2 * x >= size for x in at]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    z_runs = (runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    centred = [(x + 0.5) / size - 0.5 for x in at]
    variance = (size * size - 1) / (12 * size * size)
    z_serial = sum(a * b for a, b in zip(centred, centred[1:])) / (variance * math.sqrt(n - 1))
    tails = (math.erfc(z_chi / math.sqrt(2)) / 2, math.erfc(abs(z_runs) / math.sqrt(2)), math.erfc(abs(z_serial) / math.sqrt(2)))
    return min(1.0, 3 * min(tails))


def batteries(codes: np.ndarray, encoding: int) -> np.ndarray:
    """``battery`` of many strings of one length and encoding, given as rows of character codes."""
    size, (rows, n) = len(ENCODINGS[encoding][1]), codes.shape
    at = _PLACE[encoding][codes]
    counts = np.bincount((at + np.arange(rows)[:, None] * size).ravel(), minlength=rows * size).reshape(rows, size)
    chi = ((counts - n / size) ** 2).sum(1) / (n / size)
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = 2 * at >= size
    z_runs = ((high[:, 1:] != high[:, :-1]).sum(1) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    centred = (at + 0.5) / size - 0.5
    z_serial = (centred[:, 1:] * centred[:, :-1]).sum(1) / ((size * size - 1) / (12 * size * size) * math.sqrt(n - 1))
    worst = [min(math.erfc(x / math.sqrt(2)) / 2, math.erfc(max(abs(r), abs(c)) / math.sqrt(2))) for x, r, c in zip(z_chi.tolist(), z_runs.tolist(), z_serial.tolist())]
    return np.minimum(1.0, 3 * np.array(worst))


def battery_step(p: float | np.ndarray) -> np.ndarray:
    """Steps from the most random look (0) on."""
    return np.minimum(STEPS * MOST, np.floor(-np.log10(np.maximum(p, 10.0**-MOST)) * STEPS)).astype(int)


def ordinary_steps(codes: np.ndarray) -> Counter[tuple[int, int, int]]:
    """How many strings cut from ordinary ``codes`` there are of each (encoding, length group, battery step)."""
    out: Counter[tuple[int, int, int]] = Counter()
    for group, n in LENGTHS.items():
        rows = codes[: len(codes) // n * n].reshape(-1, n)
        if not len(rows):
            continue
        encodings = _ENCODING[np.bitwise_or.reduce(_BITS[rows], 1)]
        for e in np.unique(encodings).tolist():
            steps, counts = np.unique(battery_step(batteries(rows[encodings == e], e)), return_counts=True)
            out.update({(e, group, s): n for s, n in zip(steps.tolist(), counts.tolist())})
    return out


class Look:
    """How often ordinary strings look at least as random, by encoding, length group and battery step."""

    def __init__(self, counts: dict[tuple[int, int, int], int]) -> None:
        self.share = {}
        for e, g in {k[:2] for k in counts}:
            own = np.zeros(STEPS * MOST + 1)
            for (x, y, s), n in counts.items():
                if (x, y) == (e, g):
                    own[s] = n
            self.share[e, g] = (1 + own.cumsum()) / (1 + own.sum())

    def p_value(self, encoding: int, group: int, p: float) -> float:
        own = self.share.get((encoding, min(group, max(LENGTHS))))
        return 1.0 if own is None else float(own[battery_step(p)])


class Ordinary:
    """First-order character model of the corpus: log10 probabilities of a character after another."""

    def __init__(self, pairs: np.ndarray) -> None:
        counts = pairs.reshape(N_CHARS, N_CHARS).astype(np.float64)
        single = counts.sum(0) + 0.5
        counts += single / single.sum()  # unseen pairs fall back to the character's own frequency
        self.log = np.log10(counts / counts.sum(1, keepdims=True))

    def evidence(self, token: str, encoding: int) -> float:
        """log10 of the probability ratio of the encoding to the corpus; what follows the token does not count.

        Marks (+ / - _) join ordinary words, too, where texts have a blank: they tell nothing, and a word begins after them.
        """
        at = _CODE[np.frombuffer(token.encode(), np.uint8)]
        before = np.concatenate([[0], np.where(at[:-1] < _MARKS, at[:-1], 0)])
        said = at < _MARKS
        return float(-said.sum() * math.log10(len(ENCODINGS[encoding][1])) - self.log[before[said], at[said]].sum())


def length_group(n: int) -> int:
    return min(GROUPS - 1, n.bit_length())


def step_of(evidence: float) -> int:
    return max(0, min(STEPS * MOST, math.floor(evidence * STEPS)))


def graded(token: str, model: Ordinary, look: Look, alpha: float) -> int:
    """The step of evidence that a candidate is no ordinary string; 0 for one that the battery rejects."""
    encoding = encoding_of(token)
    p = battery(token, encoding)
    if p < alpha:
        return 0
    best = min(look.p_value(encoding, length_group(len(token)), p), 10.0 ** -max(0.0, model.evidence(token, encoding)))
    return step_of(-math.log10(min(1.0, 2 * max(best, 10.0**-MOST))))


def survey(docs: DataFrame, *, least: int) -> DataFrame:
    """(kind, at, token, n): counts of character pairs, of ordinary strings by encoding, group and step (both at ``at``), and of candidate strings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, pairs = candidate_pattern(least), np.zeros(N_CHARS * N_CHARS, np.int64)
        looks: Counter[tuple[int, int, int]] = Counter()
        names = ["kind", "at", "token", "n"]
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            tokens: Counter[str] = Counter()
            ordinary = []
            for text in texts:
                at = 0
                for m in pattern.finditer(text):
                    tokens[m[0].rstrip("=")] += 1
                    ordinary.append(text[at : m.start()])
                    at = m.end()
                ordinary.append(text[at:])
            code = _CODE[np.frombuffer("\n".join(ordinary).encode(), np.uint8)]
            for part in range(0, len(code), 1 << 22):
                looks.update(ordinary_steps((own := code[part : part + (1 << 22)])[own > 0]))
            if len(code) > 1:
                pairs += np.bincount(code[:-1] * np.uint16(N_CHARS) + code[1:], minlength=len(pairs))
            yield pa.record_batch([pa.array(["token"] * len(tokens), pa.string()), pa.nulls(len(tokens), pa.int32()), pa.array(list(tokens), pa.string()), pa.array(list(tokens.values()), pa.int64())], names=names)
        seen = np.nonzero(pairs)[0]
        yield pa.record_batch([pa.array(["pair"] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.nulls(len(seen), pa.string()), pa.array(pairs[seen])], names=names)
        at = [(e * GROUPS + g) * (STEPS * MOST + 1) + s for e, g, s in looks]
        yield pa.record_batch([pa.array(["look"] * len(at), pa.string()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.array(list(looks.values()), pa.int64())], names=names)

    return docs.mapInArrow(run, "kind string, at int, token string, n long")


def thresholds(counts: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """For each length group the least step of evidence that Benjamini-Hochberg accepts.

    ``counts`` has the candidates of each (group, step); a step bounds the p-value
    of its strings by 10 ** -(step / STEPS).
    """
    out = []
    for group in range(GROUPS):
        steps = {s: n for (g, s), n in counts.items() if g == group}
        total, above, accepted = sum(steps.values()), 0, STEPS * MOST + 1
        for step in sorted(steps, reverse=True):
            above += steps[step]
            if step > 0 and 10.0 ** (-step / STEPS) * total <= fdr * above:
                accepted = step
        out.append(accepted)
    return out


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """(doc_id, spans): ``spans`` array of (kind, start, end), by start and then kind, for every row."""
    texts = docs.select(F.col(text_col).alias("text"))
    seen = written(survey(texts, least=least), "survey")
    pairs, looks = np.zeros(N_CHARS * N_CHARS, np.int64), {}
    for row in seen.where("token is null").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        if row.kind == "pair":
            pairs[row.at] = row.n
        else:
            place, step = divmod(row.at, STEPS * MOST + 1)
            looks[*divmod(place, GROUPS), step] = row.n
    model, look = Ordinary(pairs), Look(looks)

    def grade(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[length_group(len(token)), graded(token, model, look, alpha)] += n
        rows = [(g, s, n) for (g, s), n in out.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["grp", "step", "n"])

    steps = seen.where("token is not null").select("token", "n").mapInArrow(grade, "grp int, step int, n long").groupBy("grp", "step").agg(F.sum("n").alias("n"))
    accepted = thresholds({(r.grp, r.step): r.n for r in steps.collect()}, fdr)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = candidate_pattern(least)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                starts, reach = [a for a, _, _ in spans], list(accumulate((z for _, _, z in spans), max))
                for m in pattern.finditer(text):
                    token, before = m[0].rstrip("="), bisect_left(starts, m.end())
                    if before and reach[before - 1] > m.start():
                        continue
                    if graded(token, model, look, alpha) >= accepted[length_group(len(token))]:
                        spans.append((m.start(), 3, m.end()))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    kind = docs.select(id_col).schema[0].dataType
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, keyed("doc_id", kind, "spans array<struct<kind:string,start:long,end:long>>"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = secret_spans(read_table(spark, sf_dir, "documents"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(spans: Iterable[dict]) -> str:
            return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)

        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            base = pa.array([hashlib.sha256(said(s for s in r if s["kind"] != "random").encode()).hexdigest() for r in rows], pa.string())
            yield pa.record_batch([batch.column(0), *counts[:3], base, pa.array([said(r) for r in rows], pa.string()), counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    kind = found.schema["doc_id"].dataType
    return found.mapInArrow(run, keyed("doc_id", kind, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"))
