"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Lines are described by a few shares (symbols, capitals, separators, digits, ...). The field is
trained on a bounded sample of labelled documents, each taken whole. A label says nothing about
single lines, so all lines of a document carry it, but lines that look alike in good and bad documents
cancel out, and what remains are the looks of bad lines. Sequences of one label alone would teach the
field that a state never changes; so as many sequences are mixed from a good and a bad document each
(one after the other, or one inside the other), and the moves between states are learnt from these too.
Viterbi decoding gives the most likely sequence, and the share of words in content lines decides,
after the plain base rules, whether a text stays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .rows import pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the base rules.
SYMBOLS, BLANKS, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 5

_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"#*$%&|<>~^=_{}[]\\@+", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"0123456789", b" \t\x0b\x0c\r", b".,;:'\"()-"), 1):
    _KIND[list(_chars)] = _i
N_KINDS = 6
STRETCH = 64  # lines of a training sequence; longer documents are several
FEATURES = ["always", "symbols", "capitals", "exclaims", "digits", "spaces", "points", "repeated", "short", "long", "symbol_line", "capital_line"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    if size**WINDOW < 2**62:
        key = code[:n].copy()
        for j in range(1, WINDOW):
            key = key * size + code[j : j + n]
    else:  # number the pairs, then pairs of pairs, so that keys stay exact
        two = np.unique(code[:-1] * size + code[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
        key = four[:n] * size + code[WINDOW - 1 :]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[WINDOW : WINDOW + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """(base counts), a feature row per line that holds a word, words per such line."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), np.zeros((0, len(FEATURES))), np.zeros(0)
    lines = raw.split(b"\n")
    counts = [len(x.split()) for x in lines] if len(lines) > 1 else [len(words)]
    seen: set[bytes] = set()
    repeated = []
    for line, n in zip(lines, counts):
        if n:
            repeated.append(line in seen)
            seen.add(line)
    base = (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), sum(repeated), repeated_words(words)
    )
    full = np.array(counts)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KIND[np.frombuffer(raw.replace(b"\n", b"") if len(lines) > 1 else raw, np.uint8)]
    ends = np.cumsum(sizes)
    shares = np.empty((len(lines), N_KINDS))
    for kind in range(1, N_KINDS + 1):
        total = np.concatenate([[0], np.cumsum(kinds == kind)])
        shares[:, kind - 1] = total[ends] - total[ends - sizes]
    live = full > 0
    shares, full, sizes = shares[live], full[live], sizes[live]
    symbols, capitals = shares[:, 0] / full, shares[:, 1] / sizes
    rows = np.column_stack([
        np.ones(len(full)), np.minimum(symbols, 4) / 2, capitals, np.minimum(shares[:, 2] / full, 2), shares[:, 3] / sizes,
        shares[:, 4] / sizes, np.minimum(shares[:, 5] / full, 2), np.array(repeated, float), full <= 3, full >= 40, symbols > 0.3, capitals > 0.5,
    ])
    return base, rows, full.astype(float)


class Field:
    """Two states, content 0 and boilerplate 1: weights per feature and transitions between lines."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @staticmethod
    def untrained() -> "Field":
        return Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))

    def boilerplate(self, rows: np.ndarray) -> np.ndarray:
        """Viterbi: True for the lines of the best sequence that are boilerplate; ties go to content."""
        score = rows @ self.weights
        (m00, m01), (m10, m11) = self.moves.tolist()
        c, b = score[0].tolist()
        from_b = []
        for sc, sb in score[1:].tolist():
            stay_c, stay_b = c + m00 >= b + m10, c + m01 >= b + m11
            from_b.append((not stay_c, not stay_b))
            c, b = (c + m00 if stay_c else b + m10) + sc, (c + m01 if stay_b else b + m11) + sb
        state = b > c
        out = [state]
        for back in reversed(from_b):
            state = back[state]
            out.append(state)
        return np.array(out[::-1])


def sequences(samples: list[tuple[np.ndarray, int]], lines: int = STRETCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, states) to train on: documents in stretches of at most ``lines`` lines, then mixed ones.

    The i-th bad stretch follows, precedes or stands inside of the i-th good one; the shorter list starts again.
    """
    cut = {0: [], 1: []}
    for rows, y in samples:
        cut[y] += [rows[i : i + lines] for i in range(0, len(rows), lines)]
    out = [(rows, np.full(len(rows), y)) for y in (0, 1) for rows in cut[y]]
    good, bad = cut[0], cut[1]
    for i in range(max(len(good), len(bad)) if good and bad else 0):
        g, b = good[i % len(good)], bad[i % len(bad)]
        at = (0, len(g), len(g) // 2)[i % 3]
        states = np.zeros(len(g) + len(b), int)
        states[at : at + len(b)] = 1
        out.append((np.concatenate([g[:at], b, g[at:]]), states))
    return out


class _Likelihood:
    """Log-likelihood of sequences and its slope. Sequences lie by length, so that those still going on at a line come first."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], ridge: float):
        found = sorted(found, key=lambda s: -len(s[0]))
        self.ridge, n = ridge, np.array([len(r) for r, _ in found])
        self.going = [int((n > t).sum()) for t in range(n[0])]
        at = np.concatenate([[0], np.cumsum(self.going)])
        self.at = [slice(i, j) for i, j in zip(at[:-1], at[1:])]
        place = np.concatenate([at[: len(r)] + k for k, (r, _) in enumerate(found)])
        self.x, state = np.empty((len(place), len(FEATURES))), np.empty(len(place), int)
        self.x[place], state[place] = np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])
        self.gold = np.eye(2)[state]
        self.share = np.concatenate([(1 / n / len(n))[:k] for k in self.going])  # every sequence weighs as much as any other
        self.moved = np.zeros((2, 2))
        for before, now in zip(self.at, self.at[1:]):
            k = now.stop - now.start
            self.moved += np.einsum("ia,ib,i->ab", self.gold[before][:k], self.gold[now], self.share[now])

    def slope(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.x @ weights
        fwd, bwd, top = s.copy(), np.zeros_like(s), np.logaddexp
        for before, now in zip(self.at, self.at[1:]):
            last = fwd[before][: now.stop - now.start]
            fwd[now] += top(last[:, :1] + moves[0], last[:, 1:] + moves[1])
        for before, now in zip(self.at[-2::-1], self.at[:0:-1]):
            ahead = bwd[now] + s[now]
            bwd[before][: now.stop - now.start] = top(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        norm = top(fwd[self.at[0], 0] + bwd[self.at[0], 0], fwd[self.at[0], 1] + bwd[self.at[0], 1])
        norms = np.concatenate([norm[:k] for k in self.going])[:, None]
        one = np.exp(fwd + bwd - norms) * self.share[:, None]
        two = np.zeros((2, 2))
        for before, now in zip(self.at, self.at[1:]):
            k = now.stop - now.start
            both = fwd[before][:k, :, None] + moves + (s[now] + bwd[now])[:, None, :] - norm[:k, None, None]
            two += np.einsum("iab,i->ab", np.exp(both), self.share[now])
        return self.x.T @ (self.gold * self.share[:, None] - one) - self.ridge * weights, self.moved - two - self.ridge * moves


def train(samples: list[tuple[np.ndarray, int]], steps: int = 120, ridge: float = 0.001) -> Field:
    """Maximum likelihood with a ridge by gradient steps whose lengths follow the curvature; deterministic."""
    samples = [s for s in samples if len(s[0])]
    if len({y for _, y in samples}) < 2:
        return Field.untrained()
    likelihood = _Likelihood(sequences(samples), ridge)
    n = 2 * len(FEATURES)
    at, rate, last = np.zeros(n + 4), 1.0, None
    for _ in range(steps):
        slope = np.concatenate([g.ravel() for g in likelihood.slope(at[:n].reshape(-1, 2), at[n:].reshape(2, 2))])
        if last is not None:
            step, bend = at - last[0], last[1] - slope
            curved = float(step @ bend)
            rate = min(float(step @ step) / curved, 20.0) if curved > 0 else 1.0
        if np.abs(slope).max() < 1e-5:
            break
        last = at, slope
        at = at + rate * slope
    return Field(at[:n].reshape(-1, 2), at[n:].reshape(2, 2))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_docs: int, sample_lines: int) -> Field:
    """The field of at most ``sample_docs`` labelled documents (by hash of the id), whole ones, while they have ``sample_lines`` lines together."""
    good = (
        pick(labels, label_id="doc_id", quality="quality").where("quality in (0, 1) and label_id is not null")
        .groupBy("label_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(sample_docs)
    )
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(good), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "")[1].ravel().tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "quality", "rows"],
            )

    kind = dict(texts.dtypes)["doc_id"]
    # Too long for the sample on its own: left out before its lines are measured. Of the others, as many as go in.
    short = texts.where(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < sample_lines)
    measured = (
        short.select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {kind}, quality int, rows array<double>")
        .withColumn("order", F.struct(F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("rows"))).orderBy("order").limit(sample_docs)
    )
    upto = F.sum(F.size("rows")).over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0))  # at most sample_docs rows
    got = measured.withColumn("upto", upto).where(F.col("upto") <= sample_lines * len(FEATURES)).orderBy("order").collect()
    return train([(np.array(r.rows).reshape(-1, len(FEATURES)), 1 - r.quality) for r in got])


def score_lines(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least_content: float = 0.5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: base counts, base_failed, n_lines, n_boilerplate, content_share, kept.

    A NULL or empty text has no words and fails the base rules; a NULL id keeps its row; repeated
    rows give repeated results; an empty table gives none. Lines without a word are no part of the
    sequence. The text of one row is held at a time besides its batch. ``carry`` names columns to keep.
    """
    out = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "n_lines long, n_boilerplate long, content_share double, kept boolean"
    )
    names = [c.split()[0] for c in out.split(", ")]
    wanted = {"doc_id": id_col, "text": text_col, **{f"_{c}": c for c in carry}}
    rows = pick(docs, **wanted)
    held = [c for c in rows.columns if c != "text" or text_col in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                base, lines, words = measure(text or "")
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                bad = field.boilerplate(lines) if len(lines) else np.zeros(0, bool)
                share = float(words[~bad].sum() / words.sum()) if len(lines) else 0.0
                found.append((*base, failed, len(lines), int(bad.sum()), share, not failed and share >= least_content))
            columns = list(zip(*found)) if found else [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in held], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*held, *names]
            )

    schema = ", ".join([f"`{c}` {k}" for c, k in rows.dtypes if c in held]) + ", " + out
    done = rows.mapInArrow(run, schema)
    return done.select("doc_id", *names, *[F.col(f"`_{c}`").alias(c) for c in carry])


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_content: float = 0.5,
    sample_docs: int = 2000, sample_lines: int = 60_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Fit the field on the bounded labelled sample, then ``score_lines``. Without labels of both kinds every line is content."""
    field = fitted(docs, labels, id_col, text_col, sample_docs, sample_lines)
    return score_lines(docs, field, id_col, text_col, least_content, carry)
