"""Token ids of whole columns by a public byte-level BPE vocabulary.

A token of such a vocabulary never spans the start of a word, so that a text is
cut at white space into units (a word with the one blank before it, or a run of
white space as the vocabulary's own pattern cuts it), and each distinct unit is
given to the tokenizer once; the ids of a text are those of its units in order.
Units are found in a worker's table by a 64-bit hash, and their bytes are then
compared. Texts with white space or separators beyond ASCII, or with one of the
vocabulary's added tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .textkit import Words, slices, span_hashes

#: Units kept by a worker at most; the table starts anew when it is full.
UNITS_KEPT = 600_000
# Fixed value: the pattern by which byte-level BPE files of this kind cut text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: UTF-8 of what Unicode, but not ASCII, counts as white space, and ASCII's separators.
_ODD = [bytes([x]) for x in range(0x1C, 0x20)] + [chr(x).encode() for x in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _merge_engine(path: str):
    """The vocabulary of a tokenizers file in tiktoken's merge engine, about ten times as fast on rare words.

    None, and the tokenizer itself is used, unless the file is a plain byte-level
    BPE whose ids follow the order of its merges: only then do both agree.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such files show as themselves; the others follow from 256
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:], strict=False)) or any(c not in letters for k in vocab for c in k) or len(merged) + 256 != len(vocab):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in vocab.items()}, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.odd = [*_ODD, *(t.content.encode() for t in added if t.content)]
        self.fast = _merge_engine(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.letters, self.at, self.width, self.spelt = np.zeros(1 << 18, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of units, none of which holds an added token."""
        if self.fast is not None:
            return [self.fast.encode_ordinary(t) for t in texts]
        return self._encode_whole(texts)

    def _encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; words go to the tokenizer many at a time, a line feed after each."""
        found: list[list[int]] = [[] for _ in units]
        words = [i for i, u in enumerate(units) if not u.isspace()]
        blank = [i for i, u in enumerate(units) if u.isspace()]
        for i, ids in zip(blank, self._encode([units[i] for i in blank]), strict=True):
            found[i] = ids
        feed = self._encode(["\n"])[0]
        runs = [words[i : i + 512] for i in range(0, len(words), 512)]
        for run, ids in zip(runs, self._encode(["\n".join([*(units[i] for i in run), ""]) for run in runs]), strict=True):
            ids = np.array(ids, np.int64)
            ends = np.flatnonzero(ids == feed[0])
            if len(feed) != 1 or len(ends) != len(run):  # a vocabulary that joins line feeds
                for i, one in zip(run, self._encode([units[i] for i in run]), strict=True):
                    found[i] = one
                continue
            at = 0
            flat = ids.tolist()
            for i, end in zip(run, ends.tolist(), strict=True):
                found[i], at = flat[at:end], end + 1
        return found

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        found = self._encode_units(units)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + len(flat)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        spelling = np.frombuffer("".join(units).encode(), np.uint8)
        width = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        if self.spelt + len(spelling) > len(self.letters):
            grown = np.zeros(max(2 * len(self.letters), self.spelt + len(spelling)), np.uint8)
            grown[: self.spelt] = self.letters[: self.spelt]
            self.letters = grown
        self.letters[self.spelt : self.spelt + len(spelling)] = spelling
        begin = self.spelt + np.cumsum(width) - width
        self.spelt += len(spelling)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.at = np.insert(self.at, at, begin)
        self.width = np.insert(self.width, at, width)

    def _misspelt(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which units are not spelt as their entries of the table, by comparing all bytes."""
        size = ends - starts
        wrong = size != self.width[entry]
        for i in range(0, len(starts), 1 << 18):
            n = np.where(wrong[i : i + (1 << 18)], 0, size[i : i + (1 << 18)])
            s, a = starts[i : i + len(n)], self.at[entry[i : i + len(n)]]
            unit = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
            differ = buf[s[unit] + step] != self.letters[a[unit] + step]
            wrong[i + unit[differ]] = True
        return wrong

    def encode_column(self, column: pa.Array):
        """For each run of rows: first row, end row, ids of all its rows, bounds of each row's ids."""
        for a, b, buf, offs in slices(column):
            raw = buf.tobytes()
            odd = any(x in raw for x in self.odd)
            if odd:
                whole = np.array([any(x in raw[s:e] for x in self.odd) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
                at = 0
                while at < b - a:  # runs of rows of the same kind
                    end = at + 1
                    while end < b - a and whole[end] == whole[at]:
                        end += 1
                    part, po = buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
                    if whole[at]:
                        ids = self._encode_whole([raw[offs[i] : offs[i + 1]].decode() for i in range(at, end)])
                        yield a + at, a + end, np.array([x for r in ids for x in r], np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in ids])]).astype(np.int64)
                    else:
                        yield (a + at, a + end, *self._by_units(part, po))
                    at = end
            else:
                yield (a, b, *self._by_units(buf, offs))

    def _by_units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._units(buf, offs)
        keys = span_hashes(buf, starts, ends)
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > UNITS_KEPT:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            raw = buf.tobytes()
            self._learn(distinct[new], [raw[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            at = np.searchsorted(self.keys, distinct)
        entry = at[of]
        size, begin, flat = self.sizes[entry], self.starts[entry], self.flat
        wrong = np.flatnonzero(self._misspelt(buf, starts, ends, entry))
        if len(wrong):  # another unit has the same hash: encoded apart, not kept
            raw = buf.tobytes()
            found = self._encode_units([raw[starts[i] : ends[i]].decode() for i in wrong.tolist()])
            size[wrong] = [len(x) for x in found]
            begin[wrong] = self.used + np.cumsum(size[wrong]) - size[wrong]
            flat = np.concatenate([self.flat[: self.used], np.array([x for ids in found for x in ids], np.uint32)])
        done = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(begin - done[:-1], size) + np.arange(done[-1])
        return flat[place], done[np.searchsorted(starts, offs)]

    @staticmethod
    def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans that tile every text, in order, each of whole pieces of the vocabulary's pattern."""
        w = Words(buf, offs)
        doc = np.searchsorted(offs, w.starts, side="right") - 1
        begin = offs[:-1][doc]
        joined = (w.starts > begin) & (buf[np.maximum(w.starts - 1, 0)] == 0x20)
        unit = w.starts - joined
        before = begin.copy()
        same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        before[same] = w.ends[same - 1]
        gap = unit - before
        split = ~joined & (gap > 0)
        head = before + gap - split
        a, b = gap - split > 0, split
        last = np.where(np.diff(w.bounds) > 0, w.ends[np.maximum(w.bounds[1:] - 1, 0)] if len(w.ends) else 0, offs[:-1])
        tail = last < offs[1:]
        s = np.concatenate([unit, before[a], head[b], last[tail]])
        e = np.concatenate([w.ends, head[a], unit[b], offs[1:][tail]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]
