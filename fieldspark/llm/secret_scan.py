"""Secret scans by assignment-aware lexing.

Base spans follow fixed patterns and always stay. Texts that name anything sensitive are lexed as source code and
configuration syntax: each assignment gives pairs of a target name and literals, through concatenation, chained targets,
annotations and earlier constants that it refers to. Literals are scored by their target's name and their own make;
those that pass are added where they meet no base span. Time grows with the length of the text alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from fieldspark.llm.common import lean_worker

#: Kinds in the order in which spans with one start are listed; the last is the lexer's own.
KINDS = ("assign", "access", "hex", "literal")
#: Fixed patterns of the base spans: group 2 of at least 6 characters, 20 and 24 characters.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: What a sensitive name has in it somewhere; without it nothing is lexed.
_STEM = re.compile("pass|pwd|secret|token|key|auth|cred|bearer", re.I | re.A)
_KEYWORD = re.compile("passw|secret|token|api_?key", re.I | re.A)
#: Words of names with what they say for a secret, words that make a key one, and words that say against it.
_NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "passcode": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.9, "authorization": 0.8, "pass": 0.7, "auth": 0.6,
}
_KEYS = {"api", "access", "secret", "private", "auth", "encryption", "signing", "signature", "service", "account", "master", "shared", "session", "client", "app", "ssh", "aws", "storage", "hmac", "jwt"}
_HARMLESS = {
    "length", "len", "min", "max", "size", "count", "name", "names", "file", "filename", "path", "dir", "url", "uri", "endpoint", "field", "label", "hint", "type", "policy", "expiry", "expires", "ttl", "timeout",
    "regex", "pattern", "format", "prompt", "message", "error", "reset", "public", "header", "column", "placeholder", "help", "title", "text", "version", "strength", "limit", "index", "scope", "scopes", "issuer", "provider",
}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Literals that stand for something else.
_STANDIN = re.compile(r"change.?me|change.?it|example|placeholder|dummy|sample|redacted|your[_ -]|insert|todo|xxx|\*\*\*|\.\.\.|none|null|undefined|default|password$|secret$|token$|true$|false$|<|>|\{|\}|%s|%\(", re.I)
_TOKEN = re.compile(r"(?P<ws>\s+)|(?P<op>:=|=>|==+|!=|<=|>=|=|:(?!:))|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][\w$]+)*)|(?P<quote>[\"'`])|(?P<close>\])|(?P<dash>--?)|(?P<number>\d[\w.]*)|(?P<other>.)", re.S)
_NAME, _VALUE, _GAP, _SPACE = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-][\w$]+)*"), re.compile(r"[^\s\"'`,;#(){}\[\]<>]+"), re.compile(r"[ \t]*"), re.compile(r"\s*")
_REFERENCE, _NEXT = re.compile(r"\$\{?([A-Za-z_][\w]*)\}?$"), re.compile(r"[ \t]*=(?![=>])[ \t]*")
_JOINED = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.\.?(?=[ \t\"']))[ \t]*(?:\r?\n[ \t]*)?|[ \t]+(?=[\"'])")
_STRING = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*{q}") for q in "\"'`"}
_PREFIX = re.compile(r"(?:[bBrRuUfF]{1,2}|L|u8)(?=[\"'])")
#: Scores of name and literal together that a quoted and a bare literal need; a value of more characters, or of more
#: pieces, is none that anyone takes for a secret.
QUOTED, BARE, LONGEST, PIECES = 1.4, 1.75, 4096, 32
DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in order of start, then kind; leftmost and not overlapping within a kind."""
    out = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6] if _KEYWORD.search(text) else []
    out += [(*m.span(), kind) for kind, pattern in ((1, _ACCESS), (2, _HEX)) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def name_score(name: str) -> float:
    """How much a target's name says for a secret: the most of its words, less if words say against it."""
    words = [w.lower() for w in _WORD.findall(name[-200:])]
    best = max((_NAMES.get(w.removesuffix("s"), _NAMES.get(w, 0.0)) for w in words), default=0.0)
    joined = "".join(words)
    if "key" in words and _KEYS & set(words) or "apikey" in joined:
        best = max(best, 0.9)
    return best - 0.8 if _HARMLESS & set(words) else best


def literal_score(value: str) -> float:
    """How much a literal's make says for a secret: entropy of its characters and kinds of them; spaces, stand-ins,
    addresses and paths say against it."""
    if not 6 <= len(value) <= LONGEST or _STANDIN.search(value) or len(set(value)) < 4:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    score = 0.6 * min(1.0, entropy / 3.5) + 0.2 * min(2, kinds - 1)
    if any(c.isspace() for c in value):
        score -= 0.5
    if (re.match(r"[a-z]+://", value) and "@" not in value) or value.startswith(("/", "./", "../", "~/")):
        score -= 0.6
    return score


class _Lexer:
    """One pass over a text: assignments in order, with what earlier names stand for."""

    def __init__(self, text: str) -> None:
        self.text, self.known, self.run_end, self.unclosed = text, {}, 0, {}
        self.found: list[tuple[str, list[tuple[int, int, bool]]]] = []

    def string(self, at: int) -> int | None:
        """End of the literal that the quote at ``at`` opens. One that isn't closed on its line is a plain character, and
        so are all others of its kind on the line."""
        quote = self.text[at]
        if at < self.unclosed.get(quote, 0):
            return None
        m = _STRING[quote].match(self.text, at + 1)
        if m:
            return m.end()
        line = self.text.find("\n", at)
        self.unclosed[quote] = line if line >= 0 else len(self.text)
        return None

    def bare_end(self, at: int) -> int:
        """End of the run without quotes, spaces and brackets at ``at``; each run is walked once."""
        if at >= self.run_end:
            m = _VALUE.match(self.text, at)
            self.run_end = m.end() if m else at
        return max(at, self.run_end)

    def value(self, targets: list[str], op: str, at: int) -> int:
        """Parses the value at ``at`` for ``targets``; gives where to go on."""
        text, parts, seen = self.text, [], at
        at = _GAP.match(text, at).end()
        far = _SPACE.match(text, at).end()
        if text[far : far + 1] in ("'", '"', "`") and far - at <= 200:
            at = far  # a quoted value may stand on the next line
        while at < len(text):
            prefix = _PREFIX.match(text, at)
            if prefix:
                at = prefix.end()
            if text[at] in "\"'`":
                end = self.string(at)
                if end is None:
                    break
                inner = _REFERENCE.match(text, at + 1, end - 1)
                parts += self.known.get(inner.group(1), []) if inner else [(at + 1, end - 1, True)]
                seen = at = end
                if op == ":" and not text[at : at + 200].lstrip(" \t").startswith(("+", "\\")):
                    break  # in configuration a quoted value ends there
            else:
                end = self.bare_end(at)
                if end == at:
                    break
                name = _NAME.match(text, at)
                follows = _NEXT.match(text, name.end()) if name else None
                if follows and (op != "=" or name.end() < end or text[name.end() : follows.end()].strip() == "=") and not parts:
                    if op == ":" and follows.start() != follows.end() and text[name.end()] in " \t":
                        at, op = follows.end(), "="  # name: kind = value
                        continue
                    if op in ("=", ":=") and text[name.end()] in " \t":
                        targets.append(name.group())  # a = b = value
                        at = follows.end()
                        continue
                if text[end : end + 1] in ("(", "["):
                    parts = []  # what a call or an element gives isn't known
                    break
                if name and name.end() == end and name.group() in self.known:
                    parts += self.known[name.group()]
                elif (ref := _REFERENCE.match(text, at, end)) is not None:
                    parts += self.known.get(ref.group(1), [])
                else:
                    parts.append((at, end, False))
                at = end
            joined = _JOINED.match(text, at)
            if not joined or joined.end() == at:
                break
            if len(parts) > PIECES:
                del parts[PIECES + 1 :]
            at = joined.end()
        for target in targets:
            if 0 < len(parts) <= PIECES:
                self.known[target] = parts
                self.found.append((target, parts))
            else:
                self.known.pop(target, None)
        return seen

    def run(self) -> list[tuple[str, list[tuple[int, int, bool]]]]:
        """Targets with their literals (start, end, quoted), in order."""
        text, at, target = self.text, 0, None
        while at < len(text):
            m = _TOKEN.match(text, at)
            kind, at = m.lastgroup, m.end()
            if kind == "name":
                target = m.group()
            elif kind == "quote":
                end = self.string(m.start())
                if end is None:
                    target = None
                else:
                    target = text[m.end() : end - 1] if end - m.end() <= 200 else None
                    at = end
            elif kind == "op":
                if target and m.group() in ("=", ":", ":=", "=>"):
                    at = max(at, self.value([target], m.group(), at))
                target = None
            elif kind not in ("ws", "close", "dash") or (kind == "ws" and "\n" in m.group()):
                target = None
        return self.found


def pairs(text: str) -> list[tuple[str, str]]:
    """Name and value of every assignment in ``text``, constants propagated, pieces put together."""
    return [(name, "".join(text[a:b] for a, b, _ in parts)) for name, parts in _Lexer(text).run()]


def added(text: str, base: list[Span]) -> list[Span]:
    """Literals of sensitive names that meet no base span."""
    if not _STEM.search(text):
        return []
    out: set[tuple[int, int]] = set()
    for name, parts in _Lexer(text).run():
        of_name = name_score(name) if _STEM.search(name) else 0.0
        if of_name <= 0 or sum(b - a for a, b, _ in parts) > LONGEST:
            continue
        need = QUOTED if all(q for *_, q in parts) else BARE
        if of_name + literal_score("".join(text[a:b] for a, b, _ in parts)) >= need:
            out.update((a, b) for a, b, _ in parts if b > a)
    found, k, last = [], 0, 0  # both lists ascend, so one walk finds what meets a base span
    for s, e in sorted(out):
        while k < len(base) and base[k][0] < e:
            last = max(last, base[k][1])
            k += 1
        if last <= s:
            found.append((s, e, 3))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Digest of ``documents`` (doc_id, text), one row a row, without a shuffle: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans and n_literal. A null text is empty; null ids and repeated rows stay as they are; an empty table
    has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in batches:
            lean_worker()
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added(text, base)
                counts = [sum(k == kind for *_, k in base) for kind in range(3)]
                rows.append((doc, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)


def redacted(text: Column) -> Column:
    """The text with each run of meeting spans replaced by its first kind in brackets; null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        def one(t: str) -> str:
            base = base_spans(t)
            out, at = [], 0
            for s, e, kind in sorted(base + added(t, base), key=lambda s: (s[0], s[2])):
                if s >= at:
                    out += [t[at:s], f"[{KINDS[kind].upper()}]"]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    return run(text)
