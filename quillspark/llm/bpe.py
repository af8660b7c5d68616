"""BPE encoding and decoding (operator 1).

Encoding: an Aho-Corasick automaton over the reversed vocabulary gives the longest token that
ends at a place.  The encoder walks from a word's end, where the tokens with the word-end mark
are, accepts a token only if the pair-compatibility table says that it may stand before the
one accepted last, and steps back to the next shorter one (a table again) at a dead end.  What
is behind a place has only one valid encoding, so a place that failed once is never tried
again: time is linear in the word.  In most words the longest tokens are right at once, and
one pass of the automaton gives them all.

Two tokens are compatible if no merge crosses the border between them before both are whole.
Ids are in the order of merges, so that is read off the way both came about: the parts along
the border are taken apart again, the latest first, and none of the neighbours met on the way
may have a merge of their own that comes earlier.  The table is filled as pairs occur; words
recur, so each worker keeps a bounded table of words already encoded, too.

Decoding: one blob of token texts and a table of offsets into it.

Edge cases: null text counts as empty and gives no ids and an empty decoded text; texts may
have any length; the vocabulary's special tokens in a text become their ids, as the
tokenizers library has it; repeated rows are encoded each; columns other than those named
are carried along only where `keep` names them.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ship, table

#: Words kept by each worker, and pairs in its compatibility table.
WORDS_KEPT, PAIRS_KEPT = 700_000, 1_000_000

#: Words as the vocabulary's pre-tokenizer has them, for texts of ASCII.
_WORD_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|(?:[^\s0-9a-z]|[\x1c-\x1f])+""")
#: Letters of Unicode 16 and 17 with a lower case that the library knows and Python 3.13 does not (fixed values): first, last, distance to the lower case.
_LATER_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
_LATER = {c: c + d for a, b, d in _LATER_CAPITALS for c in range(a, b + 1)}
#: Letters and numbers that Unicode 16 added to version 15.1 (fixed values): the library has them, Python 3.13 does not.
_SIXTEEN = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
_HAS_LATER = re.compile("[" + "".join(map(chr, _LATER)) + "]")
#: What str.split() takes for white space though Unicode does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_END = "\n"  # stands for the end of a word: no byte is shown by this character


def _shown_bytes() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, spare = [""] * 256, 256
    for b in plain:
        shown[b] = chr(b)
    for b in range(256):
        if not shown[b]:
            shown[b], spare = chr(spare), spare + 1
    return shown


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _word_pattern() -> regex.Pattern:
    """The vocabulary's words, with letters and numbers as of Unicode 16, which the library has; the regex module's are newer."""
    known = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _SIXTEEN)
    newer = regex.compile(rf"[[\p{{L}}\p{{N}}]--[{known}]]", regex.V1)
    runs: list[list[int]] = []
    for m in newer.finditer("".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)):
        if unicodedata.category(m[0]) == "Cn":
            if runs and runs[-1][1] == ord(m[0]) - 1:
                runs[-1][1] = ord(m[0])
            else:
                runs.append([ord(m[0])] * 2)
    later = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs) + "]" if runs else "[^\\s\\S]"
    return regex.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{later}]+|[\p{{N}}--{later}]|[[^\p{{White_Space}}\p{{L}}\p{{N}}]||{later}]+""", regex.V1)


class _Kept(dict):
    """Text -> its ids as little-endian bytes, by the given function; of WORDS_KEPT entries the older half gives way."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            got = self.make(text)
            if len(text) >= 64:
                return got
        if len(self) >= WORDS_KEPT // 2:
            self.older = dict(self)
            self.clear()
        self[text] = got
        return got


class Bpe:
    """A byte-level BPE vocabulary with word ends, from the text of its tokenizers file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        unit = lambda s: s[: -len(self.suffix)] + _END if s.endswith(self.suffix) and len(s) > len(self.suffix) else s
        merges = [tuple(map(unit, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.id = {unit(t): i for t, i in vocab.items()}
        self.text = {i: t for t, i in self.id.items()}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.shown = dict(enumerate(_shown_bytes()))
        # what each token is merged from (itself if from nothing), and its place in the order of merges
        n = max(self.text) + 1
        self.left, self.right, self.order = list(range(n)), list(range(n)), [-1] * n
        self.merge: dict[int, int] = {}
        for i, (a, b) in enumerate(merges):
            a, b, whole = self.id[a], self.id[b], self.id[a + b]
            self.left[whole], self.right[whole], self.order[whole] = a, b, i
            self.merge[a << 20 | b] = i
        # tokens that the merges of their own text give back; others never occur
        self.alone = [False] * n
        for i in sorted(self.text, key=self.order.__getitem__):
            a, b = self.left[i], self.right[i]
            self.alone[i] = a == i or self.alone[a] and self.alone[b] and self._compatible(a, b, self.order[i])
        self.found = ahocorasick.Automaton()
        self.whole = {t: i for t, i in self.id.items() if self.alone[i]}
        for t, i in self.whole.items():
            self.found.add_word(t[::-1], i)
        self.found.make_automaton()
        self.longest = self.found.iter_long
        self.size = [len(self.text.get(i, "")) for i in range(n)]
        self.shorter = [next((j for k in range(1, len(t)) if (j := self.whole.get(t[k:])) is not None), -1) for t in (self.text.get(i, "") for i in range(n))]
        self.before: dict[int, bool] = {}
        self.pattern: regex.Pattern | None = None
        self.words = _Kept(lambda w: _packed(self.word(w)))  # of chunks of several words
        self.signs = _Kept(lambda w: _packed(self.word(w)))  # of one character
        self.chunks = _Kept(self._chunk)
        shown = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in special.items()}}
        parts = [shown.get(i, "").encode() + b" " for i in range(max(shown) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def merged(self, text: str) -> list[int]:
        """Ids by applying the merges in order: what all else must agree with."""
        parts = [*text]
        if len(parts) > 1 and parts[-1] == _END:
            parts[-2:] = [parts[-2] + _END]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.id[p] for p in parts]

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge earlier than `limit` crosses the border of two whole tokens."""
        merge, order, left, right = self.merge, self.order, self.left, self.right
        while True:
            if merge.get(a << 20 | b, limit) < limit:
                return False
            # the one made later was not there yet when its parts were; of the same merge at two places, the left one comes first
            if order[a] > order[b]:
                limit, a = order[a], right[a]
            elif order[b] >= 0:
                limit, b = order[b] + 1, left[b]
            else:
                return True

    def _may_stand(self, a: int, b: int) -> bool:
        if len(self.before) >= PAIRS_KEPT:
            self.before.clear()
        got = self.before[a << 20 | b] = self._compatible(a, b, 1 << 30)
        return got

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        text = (word if word.isascii() and word.isprintable() else "".join(map(self.shown.__getitem__, word.encode()))) + _END
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        text = text[::-1]
        before = self.before
        out: list[int] = []
        for _, token in self.longest(text):  # the longest at each place, while they hold
            if out:
                ok = before.get(token << 20 | out[-1])
                if ok is None:
                    ok = self._may_stand(token, out[-1])
                if not ok:
                    break
            out.append(token)
        else:
            out.reverse()
            return out
        # one of them does not: from here on, step by step
        size, shorter, longest = self.size, self.shorter, self.longest
        at, n = sum([size[t] for t in out]), len(text)
        token = shorter[token]
        dead: set[int] = set()
        while at < n:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    if not out:
                        break
                    ok = before.get(token << 20 | out[-1])
                    if ok is None:
                        ok = self._may_stand(token, out[-1])
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = next(longest(text, at))[1]
                continue
            dead.add(at)
            if not out:
                return self.merged(text[::-1])  # not reached with a vocabulary whose tokens all come from its merges
            token = out.pop()
            at -= size[token]
            token = shorter[token]
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space in it."""
        if chunk.isalpha():  # letters alone are one word, and letters before one sign of ASCII are two
            return _packed(self.word(chunk))
        if chunk[:-1].isalpha() and chunk[-1].isascii():
            return self.chunks[chunk[:-1]] + self.signs[chunk[-1]]
        if chunk.isascii():
            return b"".join(map(self.words.__getitem__, _WORD_ASCII.findall(chunk)))
        if self.pattern is None:
            self.pattern = _word_pattern()
        if _HAS_LATER.search(chunk):
            chunk = chunk.translate(_LATER)
        return b"".join(map(self.words.__getitem__, self.pattern.findall(chunk)))

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered on its own
        text = text.lower()
        if any(map(text.__contains__, _SEPARATORS)):
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" not in text or self.split_special is None:
            return self._ordinary(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._ordinary(p) for p in self.split_special.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts with spaces between them, as UTF-8."""
        out = []
        all_ids = np.frombuffer(ids, "<u4")
        for lo in range(0, len(all_ids), 1 << 17):
            part = all_ids[lo : lo + (1 << 17)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(self.offsets[part] - (ends - lengths), lengths)].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[str, Bpe] = {}


def loaded(source: bytes) -> Bpe:
    """The vocabulary, built once in each worker."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(source)
    return _LOADED[key]


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file's bytes (1.7 MB), which are broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None) -> DataFrame:
    """The columns `keep`, `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string) of every row's whole text."""
    ship(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [bpe.encode(t or "") for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary()).cast(pa.string())], [*keep, "ids", "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "ids binary", "decoded string"])
    return rows.mapInArrow(run, schema)


def encode_only(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None) -> DataFrame:
    """As encode_decode(), without the decoded text."""
    ship(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([bpe.encode(t or "") for t in part.column("_text").to_pylist()], pa.binary())], [*keep, "ids"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "ids binary"])
    return rows.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    done = encode_decode(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
