"""BPE encoding and decoding with a pair occurrence index.

A partition's unseen words are laid out as one array of symbols. An index maps every mergeable
pair, by its rank, to all positions where it occurs in that array. Active ranks are taken in
ascending order; one step merges all occurrences of the rank's pair at once and adds the pairs that
this makes to their ranks' position lists. A merge only makes pairs of higher rank (they hold the
token just made), so one ascending pass gives what merging word by word gives.

Words repeat, so each word's ids are kept in a bounded cache per worker process and texts are
assembled from them by array lookups. No shuffle: texts are encoded where they are read.

Defined results: null or empty text has no ids and decodes to the empty text; a special token's
string in a text becomes that token's id, as the tokenizers library does by default; repeated rows
and rows with a null doc_id are encoded one by one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: Fixed by the tokenizer: how text is split before the merges; \s as the Unicode property.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
MAX_CACHED_WORDS = 600_000
CHUNK_CHARS = 1 << 21
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, to the byte.

    Printable Latin-1 characters stand for themselves, the rest for code points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.specials.values()]) + 1
        token_bytes = [b""] * size
        for token, i in ids.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            token_bytes[i] = token.encode()
        self.token_length = np.array([len(b) for b in token_bytes], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])
        self.flat_bytes = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        key = (self.left << 20) | self.right
        self.rank_of_key = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of_key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it does not merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], _NONE)


def _by_rank(ranks: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(ranks)]
    heads = ranks[bounds[:-1]].tolist() if len(ranks) else []
    for rank, a, b in zip(heads, bounds, bounds[1:], strict=False):
        yield rank, positions[a:b]


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    symbol = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    after = np.arange(1, n + 1)
    ends = np.cumsum(lengths)
    after[ends[lengths > 0] - 1] = -1
    before = np.arange(-1, n - 1)
    before[(ends - lengths)[lengths > 0]] = -1
    positions = np.flatnonzero(after >= 0)
    ranks = vocab.ranks(symbol[positions], symbol[after[positions]])
    index: dict[int, list[np.ndarray]] = {}
    good = ranks < _NONE
    for rank, found in _by_rank(ranks[good], positions[good]):
        index[rank] = [found]
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right, made = vocab.left[rank], vocab.right[rank], vocab.made[rank]
        at = at[(symbol[at] == left) & (after[at] >= 0)]
        at = at[symbol[after[at]] == right]
        if left == right and len(at) > 1:  # aaa: merge from the left, without overlaps
            chosen, taken = [], -1
            for p in at.tolist():
                if p != taken:
                    chosen.append(p)
                    taken = int(after[p])
            at = np.array(chosen)
        if not len(at):
            continue
        gone = after[at]
        far = after[gone]
        symbol[at] = made
        symbol[gone] = -1
        after[at] = far
        tail = far >= 0
        before[far[tail]] = at[tail]
        head = before[at]
        head = head[head >= 0]
        body = at[tail]
        touched = np.concatenate([head, body]) if len(head) else body
        if not len(touched):
            continue
        new = vocab.ranks(symbol[touched], symbol[after[touched]])
        good = new < _NONE
        if good.any():
            for r, found in _by_rank(new[good], touched[good]):
                if r in index:
                    index[r].append(found)
                else:
                    index[r] = [found]
                    heapq.heappush(active, r)
    live = symbol >= 0
    counts = np.zeros(len(words), np.int64)
    full = np.flatnonzero(lengths > 0)
    if len(full):
        counts[full] = np.add.reduceat(live.astype(np.int64), (ends - lengths)[full])
    return symbol[live].astype(np.int64), counts


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start:start+length], one after the other."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    shift = start - (np.cumsum(length) - length)
    return flat[np.arange(total) + np.repeat(shift, length)]


class _Numbers(dict):
    """Numbers words as they come; new: the words numbered since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordCache:
    """Ids by word. encode_words(words) gives flat ids and counts for unseen words."""

    def __init__(self, encode_words, limit: int):
        self.encode_words, self.limit = encode_words, limit
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def shrink(self) -> None:
        """Keep the older half: frequent words are met early."""
        keep = self.limit // 2
        numbers = _Numbers()
        numbers.update(islice(self.numbers.items(), keep))
        self.numbers, self.start, self.count = numbers, self.start[:keep].copy(), self.count[:keep].copy()
        self.flat = self.flat[: int(self.count.sum())].copy()

    def ids(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a list of texts given as words, and the number of ids of each text."""
        if len(self.numbers) > self.limit:
            self.shrink()
        per_text = np.array([len(t) for t in words], np.int64)
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(per_text.sum()))
        if unseen := self.numbers.new:
            self.numbers.new = []
            flat, counts = self.encode_words(unseen)
            starts = len(self.flat) + np.cumsum(counts) - counts
            self.start = np.concatenate([self.start, starts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        counts = self.count[number]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(per_text)
        return gather(self.flat, self.start[number], counts), upto[ends] - upto[ends - per_text]


@functools.cache
def _unlike() -> frozenset[str]:
    """Characters that re's letter, digit and space classes put elsewhere than the tokenizer's properties."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}"))
    found = set().union(*(set(re.findall(own, every)) ^ set(regex.findall(exact, every)) for own, exact in classes))
    return frozenset(found)


#: SPLIT in the terms of re, which is twice as fast; for texts without _unlike characters.
QUICK_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A space before something that is no white space always starts a word of SPLIT.
SPACES = re.compile(r" \s")


class Encoder:
    """Texts to ids. encode_words: list of words to (flat ids, counts); specials: their strings.

    A text is cut at its spaces, which is many times faster than by SPLIT; each different piece is then
    split into words once. Where white space follows a space, or a special token occurs, the text is
    split into words itself. Keys of the cache: a piece with a space before it as it is, a text's first
    piece after one space, a word after two.
    """

    def __init__(self, encode_words, specials, limit: int = MAX_CACHED_WORDS):
        self.encode_words = encode_words
        self.cache = WordCache(self.encode_keys, limit)
        self.exact = regex.compile(SPLIT)
        self.unlike = _unlike()
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.starts = tuple(specials)

    def plain(self, text: str) -> list[str]:
        return (QUICK_SPLIT if self.unlike.isdisjoint(text) else self.exact).findall(text)

    def keys(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is not None and any(s in text for s in self.starts):
            words = [w for part in self.special.split(text) for w in ([part] if part in self.starts else self.plain(part))]
            return ["  " + w for w in words]
        if SPACES.search(text):
            return ["  " + w for w in self.plain(text)]
        found = text.split(" ")
        found[0] = " " + found[0]
        return found

    def encode_keys(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # letters alone are one word
        words = [[" " + k] if k.isalpha() else [k[2:]] if k.startswith("  ") else self.plain(k[1:] if k.startswith(" ") else " " + k) for k in keys]
        numbers = _Numbers()
        per_key = np.fromiter(map(len, words), np.int64, len(words))
        number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(per_key.sum()))
        flat, counts = self.encode_words(numbers.new)
        own = counts[number]
        upto = np.concatenate([[0], np.cumsum(own)])
        ends = np.cumsum(per_key)
        return gather(flat, (np.cumsum(counts) - counts)[number], own), upto[ends] - upto[ends - per_key]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids([self.keys(t) for t in texts])


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One a worker process."""
    return Vocabulary(path)


@functools.cache
def shared_encoder(path: str) -> Encoder:
    """One a worker process, so that its tasks share the words they have seen."""
    return bpe_encoder(vocabulary(path))


def bpe_encoder(vocab: Vocabulary) -> Encoder:
    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [i for i, w in enumerate(words) if w in vocab.specials]
        if not special:
            return merge_words(vocab, [w.encode("utf-8", "replace") for w in words])
        flat, counts = merge_words(vocab, [b"" if w in vocab.specials else w.encode("utf-8", "replace") for w in words])
        before = np.cumsum(counts)[special]
        counts[special] = 1
        return np.insert(flat, before, [vocab.specials[words[i]] for i in special]), counts

    return Encoder(encode_words, vocab.specials)


def decode(vocab: Vocabulary, flat: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of ids; bytes that are not UTF-8 become replacement characters."""
    sizes = vocab.token_length[flat]
    data = gather(vocab.flat_bytes, vocab.token_start[flat], sizes).tobytes()
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(counts)
    bounds = zip(upto[ends - counts].tolist(), upto[ends].tolist(), strict=True)
    return [data[a:b].decode("utf-8", "replace") for a, b in bounds]


def runs(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """Whole texts in runs of about limit characters, so that memory follows the run."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. path: the vocabulary file on the workers."""
    name = path or public_tokenizers.path(TOKENIZER)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, encoder = vocabulary(name), shared_encoder(name)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for texts in runs(batch["text"].to_pylist()):
                flat, counts = encoder.encode(texts)
                raw = flat.astype("<u4").tobytes()
                ends = (np.cumsum(counts) * 4).tolist()
                sizes = (counts * 4).tolist()
                out["n_tokens"] += counts.tolist()
                out["ids_sha256"] += [hashlib.sha256(raw[e - s : e]).hexdigest() for e, s in zip(ends, sizes, strict=True)]
                out["decoded_sha256"] += [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decode(vocab, flat, counts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {"n_tokens": pa.array(out.pop("n_tokens"), pa.int64())} | {k: pa.array(v, pa.string()) for k, v in out.items()})

    return docs.select("doc_id", "text").mapInArrow(encode_all, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def bpe_stage(spark, docs, sf_dir):
    """One row per document copy: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs)
