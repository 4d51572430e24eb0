"""Token counts of whole texts.

A text of at most `chunk` characters is encoded as one piece.  A longer one is encoded in overlapping
chunks with offsets, and the chunks are spliced at a boundary that both encodings prove stable
(`common_boundary`); where the overlap has none, it is widened, in the end to all the text that is not
settled yet.  No text is cut short and no chunk is ever joined at a guessed place.

Pieces of one chunk are memoised by word where the tokenizer drops white space: words are then encoded
independently of their neighbours, which `drops_space` checks on the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fundaflow.llm.shared import arrow_map, pick

CHUNK = 16_384
OVERLAP = 512
#: Tokens on both sides of a boundary that have to agree.
AGREE = 3
#: Words a Python worker remembers at most, the longest that it remembers, and words that are encoded in one call.
MEMO_WORDS = 500_000
MEMO_BYTES = 64
TOGETHER = 200

#: White space that a word end is told by; other kinds are taken for letters.
_WORD_END = re.compile(r"(?<![ \t\n\r\x0b\x0c])[ \t\n\r\x0b\x0c]")

# The splitting pattern of vocabularies with word ends, and the normalizers in front of it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
#: Words for which that pattern is the next one: printable ASCII and Latin letters that normalization leaves alone.
_PLAIN = re.compile(r"^(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+$", re.MULTILINE)
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")


@dataclass
class Encoded:
    ids: np.ndarray
    starts: np.ndarray  # code point offsets


class Tokenizer:
    """One vocabulary file: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str):
        self.memo: dict[bytes, bytes] = {}  # words seen lately,
        self.older: dict[bytes, bytes] = {}  # and those seen before them: what is not seen again goes first
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Library

            self._t = Library.from_file(path)
            self.offsets = self._offsets_json
            self.many = lambda texts: [e.ids for e in self._t.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            self._t = sentencepiece.SentencePieceProcessor(model_file=path)
            self.offsets = self._offsets_model
            self.many = lambda texts: self._t.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no library for {path}")
        self.drops_space = path.endswith(".json") and self._drops_space()
        self.splits = self.drops_space and self._splits()
        self.pieces: dict[str, bytes] = {}

    def _offsets_json(self, text: str) -> Encoded:
        e = self._t.encode(text, add_special_tokens=False)
        starts = np.array([a for a, _ in e.offsets], np.int64)
        return Encoded(np.array(e.ids, np.uint32), starts)

    def _offsets_model(self, text: str) -> Encoded:
        pieces = self._t.encode(text, return_type="proto").pieces
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        points = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))  # of each byte's character
        return Encoded(np.array([p.id for p in pieces], np.uint32), points[[p.begin for p in pieces]] if pieces else np.zeros(0, np.int64))

    def _drops_space(self) -> bool:
        """White space gives no token and separates: a word's ids do not depend on its neighbours."""
        words = ["Ab", "don't", "x1", "(y)", "é́", "'s", "́a", "z"]
        alone = [i for w in words for i in self.many([w])[0]]
        return all(self.many([s])[0] == [] and self.many([s.join(words)])[0] == alone for s in (" ", "\t", "\n", " \r\n", "\x0b", "\x0c"))

    def _splits(self) -> bool:
        """Whether the file says that words are normalized and split by the pattern known here, and pieces encoded on their own."""
        said = json.loads(self._t.to_str())
        normal = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        split = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        special = all(a["content"].startswith("<|") and not a["normalized"] for a in said["added_tokens"])
        return normal == _NORMAL and split.get("pattern") == {"Regex": _SPLIT} and split.get("invert") is True and special and bool(said["model"].get("end_of_word_suffix"))

    def by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the place where each text ends), by looking up each distinct word once."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        flat = split.flatten().dictionary_encode()
        _, at, data = flat.dictionary.buffers()
        at, data = np.frombuffer(at, np.int32)[: len(flat.dictionary) + 1].tolist(), b"" if data is None else data.to_pybytes()
        words = [data[lo:hi] for lo, hi in zip(at, at[1:])]
        table = self._looked_up(words)
        pool = np.frombuffer(b"".join(table), np.uint32)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin = np.cumsum(size) - size
        word = flat.indices.to_numpy()
        sizes = size[word]
        ends = np.cumsum(sizes)
        ids = pool[np.repeat(begin[word] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.append(0, ends)[split.offsets.to_numpy()[1:]]

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """The little-endian 32-bit ids of distinct words, remembered where they were seen lately."""
        fresh = [w for w in words if w not in self.memo]
        if fresh:
            found = {w: self.older[w] for w in fresh if w in self.older}
            found.update(self._encoded([w for w in fresh if w and w not in found]))
            found.setdefault(b"", b"")
            if len(self.memo) + len(found) > MEMO_WORDS // 2:
                self.memo, self.older = {w: self.memo[w] for w in words if w in self.memo}, self.memo
            self.memo.update(found)
        out = [self.memo[w] for w in words]
        for w in fresh:
            if len(w) > MEMO_BYTES:
                del self.memo[w]
        return out

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that white space separates; plain ones are put together from their pieces, which many words share."""
        lines = b"\n".join(words).decode()
        plain = _PLAIN.findall(lines) if self.splits else []
        whole = list(set(lines.split("\n")).difference(plain)) if len(plain) < len(words) else []
        known = self.pieces
        pieces = _PIECES.findall("\n".join(plain).lower())
        fresh = set(pieces)
        if len(known) + len(fresh) > MEMO_WORDS // 2:
            known.clear()
        known.update(self._together(list(fresh.difference(known, ["\n"]))))
        known["\n"] = b""
        ids = list(map(known.__getitem__, pieces))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        last = [i for i, p in enumerate(pieces) if p == "\n"]
        cuts = [0, *ends[last].tolist(), *ends[-1:].tolist()]
        data = b"".join(ids)
        out = {name.encode(): data[lo:hi] for name, lo, hi in zip(plain, cuts, cuts[1:])}
        out.update((name.encode(), ids) for name, ids in self._together(whole).items())
        return out

    def _together(self, names: list[str]) -> dict[str, bytes]:
        """The ids of each of the names, many in one call: a token belongs to the name that it begins in."""
        out: dict[str, bytes] = {}
        parts = range(0, len(names), TOGETHER)
        lines = [" ".join(names[at : at + TOGETHER]) for at in parts]
        for at, e in zip(parts, self._t.encode_batch(lines, add_special_tokens=False), strict=True):
            part = names[at : at + TOGETHER]
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            starts = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            cuts = (4 * np.searchsorted(starts, np.append(0, np.cumsum(sizes)))).tolist()
            data = np.array(e.ids, np.uint32).tobytes()
            for name, lo, hi in zip(part, cuts, cuts[1:]):
                out[name] = data[lo:hi]
        return out

    def id_bytes(self, texts: list[str]) -> list[bytes]:
        """Per text, all its ids as little-endian unsigned 32-bit numbers."""
        if self.drops_space:
            ids, ends = self.by_words(texts)
            return [ids[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if texts else []
        return [np.array(ids, np.uint32).tobytes() for ids in self.many(texts)]

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        if self.drops_space and short:
            for i, n in zip(short, np.diff(self.by_words([texts[i] for i in short])[1], prepend=0).tolist(), strict=True):
                out[i] = n
        else:
            for i, ids in zip(short, self.many([texts[i] for i in short]), strict=True):
                out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > chunk:
                out[i] = len(resynchronised(t, self.offsets, chunk, overlap).ids)
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker and file."""
    return Tokenizer(path)


def word_ends(text: str, lo: int, hi: int) -> list[int]:
    """The places in text[lo:hi] where a run of anything but white space has ended and white space begins."""
    return [p for p in (lo + m.start() for m in _WORD_END.finditer(text[lo:hi])) if p > lo and not text[p - 1].isspace()]


def _begins(e: Encoded, i: int, text: str, p: int) -> bool:
    """Whether token i is the first one from p on, with nothing but dropped white space before it."""
    return i < len(e.starts) and not text[p : e.starts[i]].strip()


def common_boundary(text: str, left: Encoded, left_end: int, right: Encoded, right_begin: int) -> int | None:
    """The last place where both encodings start a token and that is proven stable, or None.

    Candidates are word ends: white space, and the word after it, hang together, and no piece of a vocabulary
    runs from a word into the white space that follows.  Proof of a word end p: a whole unit of white space and
    word lies between p and the cut-off end of the left encoding, so the word that the cut may have damaged is a
    later one, however long it is; likewise a whole unit lies between p and the beginning of the right one.
    Both start a token at p, and AGREE tokens on both sides are the same in both.  From such a place on, the
    right encoding does not depend on what came before.
    """
    ends = word_ends(text, right_begin, left_end)[1:-1]
    for p in reversed(ends):
        i, j = int(np.searchsorted(left.starts, p)), int(np.searchsorted(right.starts, p))
        x, y = slice(max(0, i - AGREE), i + AGREE), slice(max(0, j - AGREE), j + AGREE)
        if i < AGREE or j < AGREE:
            break
        if not (_begins(left, i, text, p) and _begins(right, j, text, p)):
            continue
        if np.array_equal(left.ids[x], right.ids[y]) and np.array_equal(left.starts[x], right.starts[y]):
            return p
    return None


def resynchronised(text: str, encode: Callable[[str], Encoded], chunk: int = CHUNK, overlap: int = OVERLAP) -> Encoded:
    """The encoding of the whole text from overlapping chunks."""
    n = len(text)
    ids: list[np.ndarray] = []
    starts: list[np.ndarray] = []

    def at(lo: int, hi: int) -> Encoded:
        e = encode(text[lo:hi])
        return Encoded(e.ids, e.starts + lo)

    # text[:begin] is settled, text[begin:end] is encoded in `left`, by a chunk that began at `origin`
    origin, begin, end = 0, 0, min(n, chunk)
    left = at(begin, end)
    while end < n:
        width, p = overlap, None
        while p is None:
            lo = end - width
            if lo <= begin:  # widened to all that is open: encode it anew, further, with the same text in front
                end = min(n, end + max(chunk, end - begin))
                left = at(origin, end)
                drop = np.searchsorted(left.starts, begin)
                left = Encoded(left.ids[drop:], left.starts[drop:])
                break
            hi = min(n, end + max(chunk, width))
            right = at(lo, hi)
            p = common_boundary(text, left, end, right, lo)
            width *= 2
        else:
            keep = np.searchsorted(left.starts, p)
            ids.append(left.ids[:keep])
            starts.append(left.starts[:keep])
            drop = np.searchsorted(right.starts, p)
            left, origin, begin, end = Encoded(right.ids[drop:], right.starts[drop:]), lo, p, hi
    return Encoded(np.concatenate([*ids, left.ids]), np.concatenate([*starts, left.starts]))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows pass through, other columns
    are ignored whatever their names, an empty table gives an empty table.  A map over the scan: no shuffle.
    """
    source = pick(docs, _id=id_col, _text=text_col)
    kind = source.schema["_id"].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = tokenizer(path).counts(texts, chunk, overlap)
        size = [len(t.encode("utf-8", "replace")) for t in texts]
        return pa.record_batch(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(source, count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", rows=1000)
