"""Personal data: base patterns, high-recall candidate generators, boosted trees, calibrated thresholds, redaction.

Base spans follow fixed patterns and are always kept. Generators propose further, overlapping spans of the same kinds
in usual spellings; boosted trees score each candidate from its format and its context, and those above a threshold
that is calibrated to a stated precision on candidates outside the training are added where they meet no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from fieldspark.llm.common import lean_worker, written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Generators: what parts a mail address and what follows, then (kind, pattern) of the other kinds in order.
_PARTED = re.compile(r"@|\(at\)|\[at\]|\{at\}", re.I)
_HOST = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]+)+", re.I)
_GENERATORS = (
    ("ip", re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}")),
    ("card", re.compile(r"[0-9]{4}([ ./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ ./_-])[0-9]{6}\2[0-9]{5}|[0-9]{12,19}")),
    ("phone", re.compile(r"(?:(?:\+|00)[0-9]{0,3}[ .-]?|[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}")),
)
#: More digits in a row than any number that is sought has.
_ENDLESS = re.compile(r"[0-9]{20,}")
#: Words before a span that speak for it.
_CUES = re.compile(r"(?:e-?mail|mail|contact|address|ip|host|server|card|visa|credit|payment|tel|phone|call|mobile|fax)\W*$", re.I)
#: What shows that a candidate is no personal data: words before a number, digits that it is only a part of, amounts,
#: dates, years, numbers in thousands; separators within mail addresses.
_OTHER = re.compile(r"\b(?:version|release|build|revision|order|item|invoice|article|part|sku|isbn|issn|section|chapter|page|figure|table|price|total)\W*$", re.I)
_TAIL, _HEAD = re.compile(r"[0-9](?:[._-]|\[\.\])$"), re.compile(r"(?:[._-]|\[\.\])[0-9]")
_DATE = re.compile(r"(?<![0-9])(?:[0-3]?[0-9][.-][01]?[0-9]|[01]?[0-9][.-][0-3]?[0-9])[.-](?:19|20)[0-9]{2}(?![0-9])|^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])")
_YEARS, _THOUSANDS = re.compile(r"(?:(?:19|20)[0-9]{2}[ .-]?)+"), re.compile(r"[1-9][0-9]?(?:\.[0-9]{3})+")
_AT, _DOT = re.compile(r" ?(?:@|\(at\)|\[at\]|\{at\}) ?", re.I), re.compile(r" ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?", re.I)
#: Characters of context on either side that a candidate keeps.
CONTEXT = 24
#: Most candidates that the trees are fitted on, shared equally by each kind and label, and the precision that thresholds
#: are set for.
SAMPLE, PRECISION = 20_000, 0.99
#: Lower edges of the score bins that thresholds are read from, equally far apart in log odds; places of the sample.
BINS = np.r_[0.0, 1 / (1 + np.exp(-np.linspace(-16, 16, 2047)))]
PLACES = 1 << 30
FOUND = "doc_id long, base array<struct<s:int,e:int,kind:int>>, more array<struct<s:int,e:int,kind:int,before:string,text:string,after:string,met:boolean,hit:boolean>>"
DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _local_start(text: str, end: int, done: int) -> int:
    """Where the run of a mail address's local characters before ``end`` starts, not before ``done``."""
    lo, step = end, 64
    while lo > done:
        part = text[max(done, lo - step) : lo]
        left = len(part.rstrip(_LOCAL))
        lo -= len(part) - left
        if left:
            break
        step *= 2
    return lo


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in order of start, then kind; leftmost and not overlapping within a kind. Time grows with the
    text's length alone: addresses are sought from their @, and numbers in runs that are cut once."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # The match starts where the run of local characters before the @ does, but not before the match before ended.
        lo = _local_start(text, at, done)
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):  # a run of dotted numbers matches four by four
            if m.group().count(".") >= 3:
                parts, start = m.group().split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        out.append((start, end, 1))
                    start = end + 1
        out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """Spans of the generators with context; those of different generators overlap. A span within a longer run of
    letters or digits is none. Runs of 20 digits or more are no part of any, and aren't looked into."""
    spans: list[Span] = []
    done = 0
    for m in _PARTED.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        lo = _local_start(text, end, done)
        host = _HOST.match(text, m.end()) if lo < end else None
        if host:
            spans.append((lo, host.end(), 0))
            done = host.end()
    if _DIGIT.search(text):
        short = _ENDLESS.sub(lambda m: "x" * len(m.group()), text)
        spans += [(*m.span(), kind) for kind, (_, pattern) in enumerate(_GENERATORS, 1) for m in pattern.finditer(short)]
    out = []
    for s, e, kind in spans:
        before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        if not (before[-1:].isalnum() or after[:1].isalnum()):
            out.append((s, e, kind, before, text[s:e], after))
    return out


def features(kind: int, before: str, text: str, after: str) -> list[float]:
    """Format and context of a candidate as numbers."""
    digits = _digits(text)
    groups = [len(g) for g in re.findall(r"[0-9]+", text)] or [0]
    values = [int(g) for g in re.findall(r"[0-9]{1,9}", text)] or [0]
    return [
        kind, len(text), len(digits), len(groups), max(groups), min(groups), max(values), len(set(groups)), luhn(digits) if len(digits) >= 12 else -1, text.count("."), text.count("-"), text.count(" "),
        text.count("(") + text.count("["), text[:1] == "+", "@" in text, len(text.rsplit(".", 1)[-1]), sum(c.isalpha() for c in text), len(set(digits)),
        bool(_CUES.search(before)), before[-1:].isspace() or not before, before.rstrip()[-1:].isdigit(), after.lstrip()[:1].isdigit(), before[-1:] in "./-_=#:", after[:1] in "./-_=:%", max(values) > 255,
    ]


def variants(kind: int, text: str) -> list[str]:
    """A base span in other usual spellings, by which the trees learn what the base patterns miss."""
    if kind == 0:
        user, _, host = text.partition("@")
        return [f"{user} [at] {host}", f"{user}(at){host.replace('.', '(dot)')}", f"{user} @ {host}"]
    if kind == 1:
        return [text.replace(".", "[.]"), text.replace(".", "(.)")]
    digits = _digits(text)
    if kind == 2:
        return [c.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for c in "./_"]
    return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"00{digits[:-9]} {digits[-9:-7]} {digits[-7:-4]} {digits[-4:]}"]


def refuted(kind: int, before: str, text: str, after: str) -> bool:
    """Whether format or context shows that a candidate is no personal data of its kind. False says nothing: the
    candidate may be personal data in a spelling that the base patterns miss."""
    if kind == 0:
        user, host = _AT.split(text, maxsplit=1)
        head, _, rest = host.partition(". ")  # a sentence may end within the candidate
        labels = _DOT.split(head)
        if len(labels) < 2:
            return rest[:1].isupper() or rest[:1].isdigit()
        return not ((labels[-1].isalpha() and len(labels[-1]) > 1) or labels[-1].lower().startswith("xn--")) or not any(c.isalnum() for c in user)
    if _OTHER.search(before) or before.rstrip()[-1:] in tuple("$€£¥") or after.lstrip()[:1] in tuple("%$€£¥"):
        return True
    if kind == 1:
        return any(int(p) > 255 for p in re.findall("[0-9]+", text))
    digits = _digits(text)
    if _TAIL.search(before) or _HEAD.match(after):
        return True
    if kind == 2:
        return not luhn(digits) or len(set(digits)) == 1 or _DATE.match(digits) is not None
    return len(digits) > 15 or any(r.fullmatch(text) for r in (_YEARS, _THOUSANDS)) or _DATE.search(text) is not None


def counterexamples(kind: int, text: str) -> list[str]:
    """What is no personal data but looks like a base span and its variants: an amount for a mail address, a part above
    255, a failed check digit, a number in thousands. In the place of the span, so that context alone decides nothing."""
    digits = _digits(text)
    if kind == 0:
        return [f"{len(text)} @ {len(text.partition('@')[2])}.50"]
    if kind == 1:
        parts = text.split(".")
        return [c.join([str(int(parts[0]) % 256 + 256), *parts[1:]]) for c in ("[.]", "(.)")]
    if kind == 2:
        return [v[:-1] + str((int(v[-1]) + 1) % 10) for v in variants(2, text)]
    return [f"{1 + int(digits[-8]) % 9}{digits[-7]}.{digits[-6:-3]}.{digits[-3:]}"]


@dataclass
class Boosted:
    """Gradient-boosted trees of depth 3 on binned features, logistic loss; thresholds by kind."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  #: heap order: feature or -1, bin, value
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            feature, cut, value = (np.array(c) for c in zip(*tree))
            for _ in range(3):
                f = feature[at]
                go = b[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, 2 * at + 1 + go, at)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.2, depth: int = 3) -> Boosted:
    """Fits the trees; fewer than two classes give a constant."""
    model = Boosted([np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T])
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.start = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return model
    bins, now = model._binned(x), np.full(len(y), model.start)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-now))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-9)
        tree, at = [(-1, 0, 0.0)] * (2 ** (depth + 1) - 1), np.zeros(len(y), int)
        for node in range(2**depth - 1):
            rows = np.flatnonzero(at == node)
            if len(rows) < 8:
                continue
            g, h = grad[rows], hess[rows]
            best, whole = (1e-6, -1, 0), g.sum() ** 2 / (h.sum() + 1)
            for j in range(bins.shape[1]):
                n = len(model.edges[j]) + 1
                gs, hs = (np.cumsum(np.bincount(bins[rows, j], w, n))[:-1] for w in (g, h))
                if n > 1:
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                tree[node] = (best[1], best[2], 0.0)
                at[rows] = 2 * node + 1 + (bins[rows, best[1]] > best[2])
        for node in np.unique(at).tolist():
            rows = at == node
            tree[node] = (-1, 0, float(rate * grad[rows].sum() / (hess[rows].sum() + 1)))
        now += np.array([t[2] for t in tree])[at]
        model.trees.append(tree)
    return model


def histogram(model: Boosted, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """By kind and score bin: candidates and positives among them, then the same with each counted ``rows`` times."""
    out = np.zeros((len(KINDS), len(BINS), 4), np.int64)
    at = (x[:, 0].astype(int), np.searchsorted(BINS, model.probability(x), "right") - 1)
    for k, n in enumerate((np.ones_like(rows), y, rows, y * rows)):
        np.add.at(out[..., k], at, n.astype(np.int64))
    return out


def settle(model: Boosted, counts: np.ndarray, precision: float = PRECISION) -> None:
    """For each kind the least score above which at least ``precision`` of the held-out candidates (with one negative
    added, against luck) are positive, counted once each and also by rows, so that copies can't make up for errors
    nor hide theirs; a kind without such a score gets no added spans."""
    for kind in range(len(KINDS)):
        n, hit, rows, row_hit = np.cumsum(counts[kind, ::-1], 0)[::-1].T
        good = np.flatnonzero((hit >= precision * (n + 1)) & (row_hit >= precision * rows))
        model.thresholds[kind] = float(BINS[good[0]]) if len(good) else 2.0


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> None:
    """Sets the thresholds from held-out candidates at hand, each of one row."""
    settle(model, histogram(model, x, y, np.ones(len(x))), precision)


def meetings(base: list[Span], more: list[tuple]) -> list[tuple[bool, bool]]:
    """For each candidate whether it meets a base span, and one of its own kind. Base spans of one kind ascend without
    overlaps, so the last that starts before a candidate's end decides, found by bisection."""
    spans = {kind: [b[:2] for b in base if b[2] == kind] for kind in range(len(KINDS))}
    out = []
    for s, e, kind, *_ in more:
        met = {k: bool((at := bisect_left(own, (e,))) and own[at - 1][1] > s) for k, own in spans.items() if own}
        out.append((any(met.values()), met.get(kind, False)))
    return out


def propose(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every whole text; documents without either have empty lists. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()),
            ("base", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32())]))),
            ("more", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("before", pa.string()), ("text", pa.string()), ("after", pa.string()), ("met", pa.bool_()), ("hit", pa.bool_())])))])
        for batch in batches:
            lean_worker()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans, found = [base_spans(t) for t in texts], [candidates(t) for t in texts]
            base = [[{"s": s, "e": e, "kind": k} for s, e, k in own] for own in spans]
            more = [[dict(zip(("s", "e", "kind", "before", "text", "after", "met", "hit"), (*c, *m))) for c, m in zip(cs, meetings(own, cs))] for own, cs in zip(spans, found)]
            cols = [batch.column("doc_id"), pa.array(base, schema.field("base").type), pa.array(more, schema.field("more").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def _examples(rows: list[tuple[int, str, str, str, bool, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and row counts of (kind, before, text, after, hit, n), base spans also in other spellings and
    with their counterexamples."""
    x, y, n = [], [], []
    for kind, before, text, after, hit, count in rows:
        texts = [text, *variants(kind, text)] if hit else [text]
        x += [features(kind, before, t, after) for t in texts]
        y += [float(hit)] * len(texts)
        wrong = [t for t in counterexamples(kind, text) if refuted(kind, before, t, after)] if hit else []
        x += [features(kind, before, t, after) for t in wrong]
        y += [0.0] * len(wrong)
        n += [count] * (len(texts) + len(wrong))
    return np.array(x, float), np.array(y), np.array(n, np.int64)


def labelled(found: DataFrame) -> DataFrame:
    """Distinct kind, before, text, after, hit of the candidates with their number n, fold (0: held out, by the hash of
    the text) and place in the sample.

    Left out are candidates that meet only base spans of other kinds, and those that meet none and aren't refuted: these
    may be what the base patterns miss, so they are neither positive nor negative."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in keys))
            yield batch.filter(pa.array([hit or refuted(*c) for *c, hit in rows], pa.bool_()))

    each = found.select(F.explode("more").alias("m")).select("m.*")
    keys = ("kind", "before", "text", "after", "hit")
    counted = each.where("hit or not met").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.mapInArrow(known, counted.schema)
        .withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3))).withColumn("place", F.pmod(F.xxhash64(*keys[:4]), F.lit(PLACES)))
    )


def _drawn(each: DataFrame, bound: int) -> list[tuple[int, str, str, str, bool, int]]:
    """Of each kind and label outside the held-out fold the first ``bound`` by place, or all of fewer.

    Only places below a limit, which about 1.5 times the bound are, come to the driver; with fewer of them than the
    bound by chance, these are taken.
    """
    sizes = each.where("fold > 0").groupBy("kind", "hit").count().collect()
    below = F.lit(False)
    for r in sizes:
        below |= (F.col("kind") == r["kind"]) & (F.col("hit") == r["hit"]) & (F.col("place") < int(min(1.0, (1.5 * bound + 32) / r["count"]) * PLACES))
    out: dict[tuple[int, bool], list] = {}
    for r in sorted(each.where("fold > 0").where(below).collect(), key=lambda r: (r.place, r.kind, r.before, r.text, r.after)):
        out.setdefault((r.kind, r.hit), []).append((r.kind, r.before, r.text, r.after, r.hit, r.n))
    return [c for key in sorted(out) for c in out[key][:bound]]


def _scored(each: DataFrame, model: Boosted) -> np.ndarray:
    """Histogram of all held-out candidates."""
    cols, names = ("kind", "before", "text", "after", "hit", "n"), ("c", "t", "r", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            counts = np.zeros((len(KINDS), len(BINS), 4), np.int64)
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                counts += histogram(model, *_examples(list(zip(*(batch.column(c).to_pylist() for c in cols)))))
            lean_worker()
            kind, at = np.nonzero(counts[..., 0])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), *(pa.array(counts[kind, at, k]) for k in range(4))], names=["kind", "at", *names])

    out = np.zeros((len(KINDS), len(BINS), 4), np.int64)
    every = each.where("fold = 0").select(*cols).mapInArrow(run, "kind int, at int, c long, t long, r long, u long")
    for r in every.groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["kind"], r["at"]] = [r[c] for c in names]
    return out


def train(found: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fits on distinct candidates and contexts, of each kind and label an equal part of ``sample`` at most, the first by
    a hash; calibrates on all that are held out.

    Positive: candidates that are base spans, and these in other spellings; negative: those that ``refuted`` names, and
    counterexamples. The precision that thresholds hold is against these. Two of three go to the trees, by the hash of their text, the rest
    to the thresholds. No candidates: nothing is added later.
    """
    each = written(labelled(found), "candidates")
    x, y, _ = _examples(_drawn(each, max(1, sample // (2 * len(KINDS)))))
    if not len(y):
        return Boosted()
    model = boost(x, y)
    settle(model, _scored(each, model))
    return model


def added(model: Boosted, more: list[tuple], met: list[bool]) -> list[Span]:
    """Candidates above their kind's threshold that meet no base span (``met``) and aren't refuted (a number that fails
    its check digit is never a card, say), best first and not meeting each other."""
    more = [c for c, m in zip(more, met) if not m and not refuted(*c[2:6])]
    if not more or not model.thresholds:
        return []
    score = model.probability(np.array([features(*c[2:6]) for c in more], float))
    out: list[Span] = []  # ascending
    for k in sorted(range(len(more)), key=lambda k: (-score[k], more[k][:3])):
        s, e, kind = more[k][:3]
        at = bisect_left(out, (e,))
        if score[k] >= model.thresholds.get(kind, 2.0) and not (at and out[at - 1][1] > s):
            out.insert(at, (s, e, kind))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def select(found: DataFrame, model: Boosted) -> DataFrame:
    """Digest of ``propose``'s rows: counts of base spans by kind, their sha256, all spans and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            rows = []
            for doc, base, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "more"))):
                own = [tuple(b.values()) for b in base]
                counts = [sum(k == kind for _, _, k in own) for kind in range(len(KINDS))]
                spans = own + added(model, [tuple(m.values()) for m in more], [m["met"] for m in more])
                rows.append((doc, *counts, hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans), len(spans)))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return found.mapInArrow(run, DIGEST)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Digest of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans; one row a row."""
    found = written(propose(docs), "personal")
    return select(found, train(found))


def redacted(text: Column, model: Boosted) -> Column:
    """The text with each span, or run of meeting spans, replaced by its first kind in brackets; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        lean_worker()

        def one(t: str | None) -> str | None:
            if not t:
                return t
            base = base_spans(t)
            more = candidates(t)
            spans = sorted(base + added(model, more, [m for m, _ in meetings(base, more)]), key=lambda s: (s[0], s[2]))
            out, at = [], 0
            for s, e, kind in spans:
                if s >= at:
                    out += [t[at:s], f"[{KINDS[kind].upper()}]"]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    return run(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in text, and n_chars brought up to date where there is such a column."""
    model = train(written(propose(docs), "personal"))
    out = docs.withColumn("text", redacted(F.col("text"), model))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
