"""Whole texts to token ids with the ``tokenizers`` library, at the speed of its distinct words.

Both public vocabularies split a text into pre-tokens before they merge, so the ids of a text are those of its units
in order, wherever a unit ends at a pre-token's border. Arrow cuts a batch into units and finds the distinct ones,
the library encodes those not remembered, and NumPy puts the ids together. Texts whose white space leaves doubt are
encoded whole. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units that a worker remembers unless told otherwise; beyond it those met again stay. About 200 bytes each.
MEMORY = 1_200_000
#: End of a document, units encoded as one line.
END, LINE = 2, 32

_open: dict[str, UnitEncoder] = {}


def encoder(path: str, memory: int | None = None) -> UnitEncoder:
    """The worker's encoder for a vocabulary file, the only one it keeps, from task to task."""
    if path not in _open:
        _open.clear()
        _open[path] = UnitEncoder(path)
    _open[path].memory = memory
    return _open[path]


def holds(path: str) -> bool:
    """Whether the worker has an encoder for the vocabulary file."""
    return path in _open


def forget() -> None:
    """Drops the worker's encoders."""
    _open.clear()


class UnitEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Lower case and dropped white space: units are words. Else each takes the space before it.
        self.drops_space = self.tokenizer.normalizer is not None
        #: What stands between units encoded as one line, a pre-token by itself, and its only id.
        self.between = " | " if self.drops_space else "\n"
        self.mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids[0]
        self.memory: int | None = None
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.met = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def _make_room(self, most: int) -> None:
        """Keeps at most ``most`` units, those met in most batches after their first: most units come once."""
        kept = np.flatnonzero(self.met[: len(self.codes)])
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: max(0, most)]])
        if not len(kept):
            return self._forget()
        units, lengths = list(self.codes), self.lengths[kept]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[kept] - ends + lengths, lengths) + np.arange(ends[-1])]
        self.flat = np.concatenate([flat, np.zeros(4096, flat.dtype)])  # never empty, as it grows by doubling
        self.codes = {units[k]: i for i, k in enumerate(kept.tolist())}
        self.lengths, self.starts, self.met, self.used = lengths, ends - lengths, self.met[kept], int(ends[-1])

    def _kinds(self, units: pa.Array) -> list[tuple[bool, np.ndarray]]:
        """Which units are encoded in lines, and whether through the normalizer: where white space is dropped, all without
        the bar, those of lower case ASCII and Latin-1, which it leaves as they are, past it; where units take the space
        before them, those without other white space."""

        def like(regex: str) -> np.ndarray:
            return np.asarray(pc.match_substring_regex(units, regex))

        if not self.drops_space:
            return [(True, like(r"^ ?[^\pZ\x{85}\x00-\x20]+$"))]
        bare = like(r"^[\x21-\x40\x5b-\x7b\x7d\x7e\x{df}-\x{ff}]*$")
        return [(False, bare), (True, ~bare & ~like(r"\|"))]

    def _encoded(self, texts: list[str], normal: bool = True) -> list[list[int]]:
        """Ids of each text, if not ``normal`` past the normalizer."""
        if normal:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        held = self.tokenizer.normalizer
        self.tokenizer.normalizer = None
        try:
            return self._encoded(texts)
        finally:
            self.tokenizer.normalizer = held

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and how many each has. Most are encoded in lines of ``LINE``."""
        lengths, parts, left = np.zeros(len(units), np.int64), [], np.ones(len(units), bool)
        for normal, those in self._kinds(pa.array(units, pa.string())):
            joined = [units[k] for k in np.flatnonzero(those).tolist()]
            lines = [self.between.join([*joined[at : at + LINE], ""]) for at in range(0, len(joined), LINE)]
            ids = self._encoded(lines, normal)
            own = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
            marks = np.flatnonzero(own == self.mark)
            if len(marks) != len(joined):
                raise ValueError("what stands between units is no token of its own")
            lengths[those] = np.diff(marks, prepend=-1) - 1
            parts.append((those, np.delete(own, marks)))
            left &= ~those
        ids = self._encoded([units[k] for k in np.flatnonzero(left).tolist()])
        lengths[left] = list(map(len, ids))
        parts.append((left, np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))))
        out = np.zeros(int(lengths.sum()), np.int64)
        for those, own in parts:
            out[np.repeat(those, lengths)] = own
        return out, lengths

    def _learn(self, units: list[str]) -> None:
        first = len(self.codes)
        for at in range(0, len(units), 4096):
            ids, lengths = self._ids(units[at : at + 4096])
            ends = self.used + np.cumsum(lengths)
            k = first + at
            while k + len(lengths) > len(self.lengths):
                self.lengths, self.starts, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts, self.met))
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : ends[-1]] = ids
            self.lengths[k : k + len(lengths)], self.starts[k : k + len(lengths)], self.met[k : k + len(lengths)] = lengths, ends - lengths, 0
            self.used = int(ends[-1])
        self.codes.update(zip(units, range(first, first + len(units))))

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and how many each text has."""
        if self.drops_space:
            cut = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
            cut = pc.replace_substring_regex(cut, "([a-z])([.,] )", r"\1 \2")
            lists = pc.split_pattern(cut, " ")
        else:
            cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 ")
            cut = pc.replace_substring_regex(cut, "([A-Za-z])([.,]\x01)", "\\1\x01\\2")
            odd = pc.match_substring_regex(texts, r"[\pZ\s\x{85}\x1c-\x1f][\pZ\s\x{85}\x1c-\x1f]|^[\pZ\s\x{85}]|[\pZ\s\x{85}]$|[\x01\t\x0b-\x0d]")
            lists = pc.split_pattern(pc.if_else(odd, texts, cut), "\x01")
            if pc.any(odd).as_py():  # whole texts; one that holds the mark itself must not be cut there
                whole = pa.array([[t] if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist())], lists.type)
                lists = pc.coalesce(whole, lists)
        values = lists.flatten()
        return values, np.asarray(pc.list_value_length(lists))

    def encode(self, texts: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each; a null text is empty."""
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        values, units = self._units(texts)
        found = values.dictionary_encode()
        words = found.dictionary.to_pylist()
        memory = self.memory or MEMORY
        if len(self.codes) + len(words) > memory:
            self._make_room(min(memory // 2, memory - len(words)))
        known = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        self.met[known[known >= 0]] += 1
        known[new] = np.arange(len(self.codes), len(self.codes) + len(new))
        self._learn([words[k] for k in new.tolist()])
        codes = known[np.asarray(found.indices)]
        lengths = self.lengths[codes]
        # ids of unit i go to [at[i], at[i] + lengths[i])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.starts[codes] - upto[:-1], lengths) + np.arange(upto[-1])]
        offsets = upto[np.concatenate([[0], np.cumsum(units)])]
        if end is None:
            return ids.astype(np.uint32), offsets
        out = np.full(len(ids) + len(texts), end, np.uint32)
        ends = offsets[1:] + np.arange(len(texts))
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = ids
        return out, np.concatenate([[0], ends + 1])


def slices(texts: pa.Array, most_bytes: int = 3_000_000):
    """(start, length) of runs of texts with about ``most_bytes`` of text, a longer text by itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and total + n > most_bytes:
            yield at, k - at
            at, total = k, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes) - at
