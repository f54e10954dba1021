"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans (e-mail, IP, card, phone) come from exact patterns, leftmost and non-overlapping per kind. The field works on
the tokens that hold a digit or an ``@``. Its factors are a token's shape and its neighbours' shapes, the labels of
adjacent tokens (chain edges), and the labels of tokens that repeat the same address, or a number with the same last ``ALIKE`` digits, anywhere in
the document, however its digits are grouped over adjacent tokens (skip edges, from each repeat to one shared variable of the value, so that all repeats are two hops apart
and the edges' number is linear; their factor is counted on consecutive repeats). All factors are
log-odds of counts over the whole corpus, labelled by the base spans (piecewise training); shapes are hashed into
``BUCKETS`` buckets, so the tables that are broadcast have a fixed size. Loopy sum-product messages, exchanged until
they settle, give each token's belief; base tokens are clamped to their kind. Tokens outside base spans whose belief in one kind reaches ``SURE``
are added, adjacent ones of a kind as one span while its digits fit the kind.

Two passes over the texts, no shuffle of them. Work and memory of a document are linear in its length.

Defined results: a null text is empty and has no spans; offsets are code points, end exclusive; rows are never
merged; on an empty table the field knows nothing and adds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import bounded_batches

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
BUCKETS = 1 << 14
TEMPLATES = 3
STEP = 0.5
TOLERANCE = 1e-3
STEADY = 100
COOLING = 0.95
SURE = 0.95
CLAMP = 20.0
MOST_DIGITS = (0, 0, 19, 15)
ALIKE = 7
LONGEST_NUMBER = 19

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"[0-9]+")
NAME = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}|]+")
ENDS = ".()"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                found.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(len, RUN.findall(m.group()))) <= 15:
                    found.append((3, *m.span()))
    return found


def shape(token: str) -> str:
    """Runs of digits by length, letters as one ``a``; checked for cards and addresses."""
    out = NAME.sub("a", RUN.sub(lambda m: f"9{len(m.group())}", token))
    digits = "".join(RUN.findall(token))
    if 13 <= len(digits) <= 19 and NAME.search(token) is None:
        out += "L" if luhn(digits) else "N"
    if token.count(".") == 3 and NAME.search(token) is None:
        parts = token.split(".")
        out += "V" if all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else "W"
    return out


def _mentions(said: list[str], span: list[int], adjacent: list[bool]) -> Iterator[tuple[str, list[int]]]:
    """``(key, tokens)`` of each mention of an address or a number.

    A number is a base span (its last token stands for it), a token of ``ALIKE`` digits or more, or a stretch of adjacent
    free tokens without letters. Inside such a stretch it ends where its last ``ALIKE`` digits are those of a known
    number, and goes back as far as the digits agree with that number's; a stretch without one is a number itself, up to
    ``LONGEST_NUMBER`` digits. Addresses of four parts are compared whole.
    """
    digits = ["".join(RUN.findall(x)) for x in said]
    plain = ["@" not in x and NAME.search(x) is None for x in said]
    known: dict[str, tuple[str, int]] = {}  # the number, and the stretch that alone holds it, or -1
    spans, stretches = [], []
    for i, x in enumerate(said):
        if "@" in x:
            yield x.lower(), [i]
        elif plain[i] and x.count(".") == 3 and max(map(len, x.split("."))) <= 3:
            yield x, [i]
        else:
            runs = stretches if span[i] < 0 else spans
            joins = runs and runs[-1][-1] == i - 1 and span[i - 1] == span[i]
            if joins and (span[i] >= 0 or adjacent[i] and plain[i] and plain[i - 1]):
                runs[-1].append(i)
            else:
                runs.append([i])
    for run in spans:
        number = "".join(digits[i] for i in run)
        if len(number) >= ALIKE:
            known.setdefault(number[-ALIKE:], (number, -1))
            yield number[-ALIKE:], run[-1:]
    for run in stretches:
        for number in (digits[i] for i in run if len(digits[i]) >= ALIKE):
            known.setdefault(number[-ALIKE:], (number, -1))
    for r, run in enumerate(stretches):
        number = "".join(digits[i] for i in run)
        if ALIKE <= len(number) <= LONGEST_NUMBER:
            first, owner = known.setdefault(number[-ALIKE:], (number, r))
            if owner not in (-1, r):
                known[number[-ALIKE:]] = first, -1
    for r, run in enumerate(stretches):
        line = "".join(digits[i] for i in run)
        end, k, found = len(line), len(run) - 1, False
        while k >= 0:
            i = run[k]
            value, owner = known.get(line[end - ALIKE : end], ("", r)) if end >= ALIKE else ("", r)
            if owner == r:
                end, k = end - len(digits[i]), k - 1
                continue
            same = ALIKE
            while same < min(len(value), end) and value[-same - 1] == line[end - same - 1]:
                same += 1
            key, start, at = value[-ALIKE:], end - same, []
            while k >= 0 and end > start:
                at.append(run[k])
                end, k = end - len(digits[run[k]]), k - 1
            found = True
            yield key, at[::-1]
        if not found and ALIKE <= len(line) <= LONGEST_NUMBER:
            yield line[-ALIKE:], run


class Field:
    """The field of one document: tokens, features, edges, base labels; ``skip`` has consecutive repeats, ``members`` a value and its tokens."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.at: list[tuple[int, int]] = []
        shapes, said, adjacent, before, after = [], [], [], [], []
        last_end, last_word, pending = -2, "", False
        for m in TOKEN.finditer(text):
            token = m.group()
            start, end = m.span()
            if pending:
                after.append(shape(token)[:20])
            pending = False
            if "@" in token or DIGIT.search(token):
                cut = token.rstrip(ENDS[0])
                end = start + len(cut)
                self.at.append((start, end))
                shapes.append(shape(cut))
                said.append(cut)
                adjacent.append(start - last_end == 1 and bool(self.at[:-1]) and self.at[-2][1] == last_end)
                before.append(last_word)
                pending = True
            last_end, last_word = end, shape(token)[:20]
        if pending:
            after.append("")
        n = len(self.at)
        hashed = lambda kind, xs: [zlib.crc32(f"{kind}{x}".encode("utf-8", "surrogatepass")) % BUCKETS for x in xs]
        self.features = np.array([hashed("s", shapes), hashed("b", before), hashed("a", after)], np.int64).reshape(TEMPLATES, n)
        self.base = np.full(n, OTHER)
        span = [-1] * n
        marks = sorted((a, b, k) for k, a, b in spans)
        j = 0
        for i, (a, b) in enumerate(self.at):
            while j < len(marks) and marks[j][1] <= a:
                j += 1
            for m in range(j, len(marks)):
                if marks[m][0] >= b:
                    break
                if marks[m][1] > a:
                    self.base[i], span[i] = marks[m][2], m
                    break
        self.chain = np.array([(i - 1, i) for i in range(1, n) if adjacent[i]], np.int64).reshape(-1, 2)
        seen: dict[str, list[list[int]]] = {}
        for key, at in _mentions(said, span, adjacent):
            seen.setdefault(key, []).append(at)
        repeated = [sorted(places, key=lambda at: at[-1]) for places in seen.values() if len(places) > 1]
        self.values = len(repeated)
        self.skip = np.array([pair for places in repeated for pair in zip((at[-1] for at in places), (at[-1] for at in places[1:]))], np.int64).reshape(-1, 2)
        self.members = np.array([(v, i) for v, places in enumerate(repeated) for at in places for i in at], np.int64).reshape(-1, 2)


class Potentials:
    """Log factors from the corpus counts ``(table, bucket, label) -> count``; table 3 holds chain, 4 skip label pairs."""

    def __init__(self, counts: dict[tuple[int, int, int], int]):
        size = OTHER + 1
        table = np.zeros((TEMPLATES, BUCKETS, size))
        pairs = np.zeros((2, size, size))
        for (t, b, label), c in counts.items():
            if t < TEMPLATES:
                table[t, b, label] += c
            else:
                pairs[t - TEMPLATES, b, label] += c
        prior = table[0].sum(axis=0) + 1
        self.known = bool(counts)
        self.prior = np.log(prior / prior.sum())
        rate = (table + 0.5 * prior / prior.sum()) / (table.sum(axis=2, keepdims=True) + 0.5)
        self.odds = np.log(rate) - self.prior
        both = pairs + 1e-2
        rows, cols = both.sum(axis=2, keepdims=True), both.sum(axis=1, keepdims=True)
        self.pairs = np.log(both * both.sum(axis=(1, 2), keepdims=True) / (rows * cols))

    @classmethod
    def of(cls, state: dict) -> Potentials:
        """The potentials whose ``vars`` these are: plain arrays, which any worker can read."""
        potentials = cls.__new__(cls)
        vars(potentials).update(state)
        return potentials

    def beliefs(self, field: Field) -> np.ndarray:
        """Loopy sum-product over chain and skip edges: label probabilities of each token.

        Rounds go on until no message changes by ``TOLERANCE``. The steps of a field that has not settled in time for
        messages to cross its longest run of adjacent tokens are cooled, since loops may swing for ever.
        """
        unary = self.prior + sum(self.odds[t][field.features[t]] for t in range(TEMPLATES))
        fixed = field.base != OTHER
        unary[fixed] = -CLAMP
        unary[fixed, field.base[fixed]] = 0
        n = len(unary)
        unary = np.vstack([unary, np.zeros((field.values, OTHER + 1))])
        edges = np.vstack([field.chain, field.members + [n, 0]])
        factor = np.concatenate([np.repeat(self.pairs[i][None], len(e), axis=0) for i, e in enumerate((field.chain, field.members))])
        messages = np.zeros((2, len(edges), OTHER + 1))  # 0: to the later token, 1: to the earlier one or the value
        breaks = np.flatnonzero(np.diff(field.chain[:, 0]) != 1)
        longest = int(np.diff([-1, *breaks, len(field.chain) - 1]).max())
        step, rounds, change = STEP, 0, np.inf
        while len(edges) and change > TOLERANCE and step > TOLERANCE:
            total = self._total(unary, edges, messages)
            right = _logsum(factor + (total[edges[:, 0]] - messages[1])[:, :, None], 1)
            left = _logsum(factor + (total[edges[:, 1]] - messages[0])[:, None, :], 2)
            new = np.stack([right, left])
            new -= new.max(axis=2, keepdims=True)
            change = np.abs(new - messages).max()
            messages += step * (new - messages)
            rounds += 1
            if rounds > STEADY + 4 * longest:
                step *= COOLING
        total = self._total(unary, edges, messages)[:n]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    @staticmethod
    def _total(unary, edges, messages):
        total = unary.copy()
        np.add.at(total, edges[:, 1], messages[0])
        np.add.at(total, edges[:, 0], messages[1])
        return total


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def count_factors(texts) -> Counter:
    """Factor counts of the texts, labelled by their base spans."""
    counts: Counter = Counter()
    for text in texts:
        if text and ("@" in text or DIGIT.search(text)):
            field = Field(text, base_spans(text))
            for t in range(TEMPLATES):
                counts.update((t, int(b), int(y)) for b, y in zip(field.features[t], field.base))
            for t, edges in ((TEMPLATES, field.chain), (TEMPLATES + 1, field.skip)):
                counts.update((t, int(field.base[i]), int(field.base[j])) for i, j in edges)
    return counts


def added_spans(text: str, base: list[tuple[int, int, int]], potentials: Potentials) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base ones."""
    if not potentials.known or not ("@" in text or DIGIT.search(text)):
        return []
    field = Field(text, base)
    free = field.base == OTHER
    if not free.any():
        return []
    belief = potentials.beliefs(field)
    label = belief.argmax(axis=1)
    taken = free & (label != OTHER) & (belief.max(axis=1) >= SURE)
    chained = {int(j) for _, j in field.chain}
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(taken):
        k, (a, b) = int(label[i]), field.at[i]
        if out and i in chained and taken[i - 1] and out[-1][0] == k and sum(map(len, RUN.findall(text[out[-1][1] : b]))) <= MOST_DIGITS[k]:
            out[-1] = (k, out[-1][1], b)
        else:
            out.append((k, a, b))
    return out


def fit(docs: DataFrame) -> Potentials:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = count_factors(pdf["text"])
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["t", "b", "y", "n"])

    rows = bounded_batches(docs).select(F.col("text").cast("string").alias("text")).mapInPandas(work, "t int, b int, y int, n long")
    return Potentials({(r["t"], r["b"], r["y"]): r["n"] for r in rows.groupBy("t", "b", "y").agg(F.sum("n").alias("n")).collect()})


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "added")]))


def all_spans(text: str | None, potentials: Potentials) -> list[dict[str, int]]:
    base = base_spans(text or "")
    both = [(*x, 0) for x in base] + [(*x, 1) for x in added_spans(text or "", base, potentials)]
    return [dict(zip(("kind", "start", "end", "added"), x)) for x in sorted(both)]


def find(docs: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """Every row of ``docs`` with ``__spans``: kind number, start, end, and whether the field added it."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(potentials or fit(docs)))
    arrow = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "added")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Potentials.of(shared.value)
        for batch in batches:
            found = pa.array([all_spans(t.as_py(), learned) for t in batch.column("text")], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "__spans"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("__spans", SPAN)]))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts per kind, digest of the base spans, all spans, number of added ones."""
    rows = find(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "__spans")
    names = F.array(*map(F.lit, KINDS))
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("__spans", lambda s: s["added"] == 0)
    count = lambda k: F.size(F.filter("__spans", lambda s: (s["added"] == 0) & (s["kind"] == k))).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("__spans")).alias("spans"),
        F.size(F.filter("__spans", lambda s: s["added"] == 1)).cast("bigint").alias("n_added"),
    )


def masked_text(text: str | None, spans) -> str | None:
    """The text with each span (overlapping ones together) replaced by the name of its first kind."""
    if not text or not spans:
        return text
    out, at, shown = [], 0, -1
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at or shown < 0:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            shown = kind
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """The documents with personal data replaced by the name of its kind; ``n_chars`` follows where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(potentials or fit(docs)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Potentials.of(shared.value)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            clean = (masked_text(t, all_spans(t, learned)) for t in (x.as_py() for x in batch.column(i)))
            columns = [*batch.columns]
            columns[i] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
