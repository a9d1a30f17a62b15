"""Encoders used inside tasks.  Tokenizer files are parameters and are only read, never trained."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _evict(cache: dict, limit: int) -> None:
    """Keeps a cache under ``limit`` entries: the older half goes."""
    if len(cache) >= limit:
        for key in list(itertools.islice(cache, limit // 2)):
            del cache[key]


def plain_texts(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty, in buffers of its own (some Arrow kernels misread a slice)."""
    kind = pa.large_string()
    return pa.concat_arrays([pc.fill_null(column.cast(kind), ""), pa.array([], kind)])


LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
MARK = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation without the apostrophe
BOUNDARY = f"([{LETTER}])([{MARK}])"


def _joined(prefix: str, words: pa.Array) -> pa.Array:
    empty, blank = (pa.scalar(x, words.type) for x in ("", prefix))
    return pc.binary_join_element_wise(empty, words, blank)


def _taken(table: pa.Array, codes: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """Entries ``table[code]`` one after another, and where each begins and the last ends, in bytes."""
    taken = table.take(codes)
    if not len(taken):
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    return taken.buffers()[2] or pa.py_buffer(b""), np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]


def _word_table(words: pa.Array, separator: str, encode: Callable[[list[str]], list[bytes]]) -> pa.Array:
    """Ids of each word, as bytes: words are cut between a letter and a mark, each distinct part is encoded once."""
    split = pc.split_pattern(pc.replace_substring_regex(words, BOUNDARY, rf"\1{separator}\2"), separator)
    coded = pc.dictionary_encode(split.flatten())
    parts = pa.array(encode(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
    data, starts = _taken(parts, coded.indices)
    bounds = starts[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), data])


def _spread(table: pa.Array, codes: pa.Array, bounds: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and where the ids of each text begin, from the codes of all words and the words of each text."""
    data, starts = _taken(table, codes)
    return np.frombuffer(data, dtype, starts[-1] // dtype.itemsize), starts[bounds] // dtype.itemsize


class WordCachedEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, with bounded caches.

    For a tokenizer whose pre-tokens never hold or cross white space and whose normalizer drops
    it, the ids of a text are the ids of its space-separated words, one after another.  Texts are
    split at blanks and line feeds only; any other white space stays inside a word and goes to the
    library.  Each distinct word of a batch is looked up once.  A part of Latin-1 letters or of ASCII
    punctuation (which normalization only lower-cases) goes straight to the library's BPE model; every
    other one goes through the whole library.
    """

    SIMPLE = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str, limit: int = 200_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.limit = limit
        self.words: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Words stand for themselves in this family of files only; others are refused.
        self.short_cut = (
            [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed"
        )
        if not self.short_cut:
            raise ValueError(f"{path}: not a word-level pipeline that drops white space")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        self.byte_chars = {b: b for b in kept} | {b: 256 + n for n, b in enumerate(others)}

    def encode_words(self, words: list[str]) -> list[bytes]:
        known, simple, tokenize = self.words, self.SIMPLE.fullmatch, self.model.tokenize
        _evict(known, self.limit)
        out = list(map(known.get, words))
        odd = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            word = words[i]
            if simple(word):
                part = word.lower()
                if not part.isascii():
                    part = part.encode().decode("latin-1").translate(self.byte_chars)
                out[i] = ids = array(self.code, [t.id for t in tokenize(part)]).tobytes()
                if len(word) <= 48:
                    known[word] = ids
            else:
                odd.append(i)
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for i, got in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = array(self.code, got.ids).tobytes()
                if len(words[i]) <= 48:
                    known[words[i]] = out[i]
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and where each text's ids begin and end.

        ASCII letters are lower-cased and words cut at marks first, unless a special token's string may stand in a text.
        """
        column = plain_texts(column)
        whole = not pc.any(pc.match_substring(column, "<|")).as_py()
        if whole:
            column = pc.ascii_lower(column)
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = pc.dictionary_encode(split.flatten())
        table = _word_table(coded.dictionary, " ", self.encode_words) if whole else pa.array(self.encode_words(coded.dictionary.to_pylist()), pa.large_binary())
        return _spread(table, coded.indices, split.offsets.to_numpy() - split.offsets[0].as_py(), self.dtype)


_ENCODERS: dict[str, WordCachedEncoder] = {}


def word_encoder(path: str) -> WordCachedEncoder:
    """The encoder of this Python worker; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Merge ranks in a three-level bitmap; each rank has a bucket of linked-list positions.

    ``pop`` finds the least rank by three find-first-set steps and gives its leftmost position.
    Entries whose pair has changed since are left in place and skipped by the caller.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        if not self.low[word]:
            group = word >> 6
            self.mid[group] |= 1 << (word & 63)
            self.top |= 1 << group
        self.low[word] |= 1 << (rank & 63)

    def put(self, rank: int, positions: list[int]) -> None:
        """As ``push``, for several positions and a bucket without order."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.push(rank, positions[0])
        self.buckets[rank] = positions

    def take(self, rank: int) -> list[int]:
        bucket = self.buckets[rank]
        self.drop(rank)
        return bucket

    def least(self) -> int:
        top = self.top
        if not top:
            return -1
        group = (top & -top).bit_length() - 1
        mid = self.mid[group]
        word = group << 6 | (mid & -mid).bit_length() - 1
        low = self.low[word]
        return word << 6 | (low & -low).bit_length() - 1

    def drop(self, rank: int) -> None:
        del self.buckets[rank]
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            group = word >> 6
            self.mid[group] &= ~(1 << (word & 63))
            if not self.mid[group]:
                self.top &= ~(1 << group)


class BytePairCodec:
    """Byte-level BPE by merge ranks, through the rank queue, with bounded caches.

    Gives the ids the ``tiktoken`` library gives for ordinary text under the same pattern.
    ``\\s`` in the pattern is Unicode White_Space, as there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.size = max(ranks.values()) + 1
        self.table = [b""] * self.size
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self.queue = RankQueue(self.size)
        self.limit = limit
        self.words: dict[str, bytes] = {"": b""}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = sorted((ranks[p[:i]] * (self.size + 1) + ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] + [(self.size + 1) ** 2 + 1])
        self.pair_rank = np.array([r for _, r in pairs] + [-1])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, merges until no pair has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, queue = len(piece), self.queue
        buckets, push = queue.buckets, queue.push
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        before = list(range(-1, n - 1))  # before[i]: where the part before it starts
        pair = [-1] * n  # rank of the part at i joined with the next
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        while queue.top:
            rank = queue.least()
            bucket = buckets[rank]
            while bucket:
                i = bucket[0]
                if pair[i] != rank:  # stale
                    heappop(bucket)
                    continue
                heappop(bucket)
                j = end[i]
                stop = end[i] = end[j]
                pair[j] = -1
                if stop < n:
                    before[stop] = i
                    now = get(piece[i : end[stop]], -1)
                else:
                    now = -1
                pair[i] = now
                lower = False
                if now >= 0:
                    push(now, i)
                    lower = now < rank
                k = before[i]
                if k >= 0:
                    now = pair[k] = get(piece[k:stop], -1)
                    if now >= 0:
                        push(now, k)
                        lower = lower or now < rank
                if lower:
                    break
            if not bucket:
                queue.drop(rank)
        out, i = [], 0
        while i < n:
            stop = end[i]
            out.append(ranks[piece[i:stop]])
            i = stop
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32-bit, little-endian) of many pre-tokens, all in one queue.

        Pre-tokens don't touch each other, so the least rank over all of them is the least rank of each
        that has it, and its bucket merges at once: the leftmost pair of each pre-token per round.
        """
        if not pieces:
            return []
        n = sum(map(len, pieces)) + len(pieces) + 1
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        gaps = np.concatenate(([0], np.cumsum(sizes + 1)))  # a gap before each pre-token, one at the end
        token = self.byte_ids[raw].astype(np.int64)
        token[gaps] = self.size  # stands for no token; no pair with it has a rank
        owner = np.repeat(np.arange(len(pieces) + 1), np.diff(np.concatenate((gaps, [n]))))
        end = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.pair_ranks(token[:-1], token[1:])
        queue = RankQueue(self.size)
        order = np.argsort(pair, kind="stable")
        order = order[pair[order] >= 0]
        ranks = pair[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for at, part in zip(np.concatenate(([0], cuts)).tolist() if len(ranks) else [], np.split(order, cuts)):
            queue.put(int(ranks[at]), part.tolist())
        while queue.top:
            rank = queue.least()
            at = np.array(queue.take(rank))
            at = at[pair[at] == rank]  # the rest is stale
            if len(at) > 1:
                at = np.unique(at)
                first = np.ones(len(at), bool)
                first[1:] = owner[at[1:]] != owner[at[:-1]]
                if not first.all():
                    queue.put(rank, at[~first].tolist())
                    at = at[first]
            if not len(at):
                continue
            after = end[at]
            stop = end[after]
            end[at] = stop
            before[stop] = at
            pair[after] = -1
            token[at] = rank
            left = before[at]
            changed = np.concatenate((at, left))
            now = self.pair_ranks(token[changed], np.concatenate((token[stop], token[at])))
            pair[changed] = now
            changed, now = changed[now >= 0], now[now >= 0]
            if len(now) > 64:
                order = np.argsort(now)
                changed, now = changed[order].tolist(), now[order]
                cuts = [0, *(np.flatnonzero(now[1:] != now[:-1]) + 1).tolist(), len(changed)]
                for r, a, b in zip(now[cuts[:-1]].tolist(), cuts, cuts[1:]):
                    queue.put(r, changed[a:b])
            else:
                for r, i in zip(now.tolist(), changed.tolist()):
                    queue.put(r, [i])
        dead = np.ones(n, bool)
        starts = gaps[:-1] + 1
        dead[gaps] = False
        dead[starts] = False
        live_at = starts
        while len(live_at):  # follow the list of every pre-token one step at a time
            dead[live_at] = False
            live_at = end[live_at]
            live_at = live_at[token[live_at] != self.size]
        dead[gaps] = True
        ids = token[~dead].astype("<u4")
        counts = np.bincount(owner[~dead], minlength=len(pieces))
        ends = np.cumsum(counts) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens joined, or -1."""
        keys = left * (self.size + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], -1)

    SIMPLE = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| ?[!-&(-/:-@\[-`{-~]+")

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, encoded as it stands; the pre-tokens unknown so far share a queue."""
        words, simple = self.words, self.SIMPLE.fullmatch
        _evict(words, self.limit)
        out = list(map(words.get, chunks))
        odd, missing = [], set()
        for i in [i for i, ids in enumerate(out) if ids is None]:
            chunk = chunks[i]
            parts = [chunk] if simple(chunk) else self.pattern.findall(chunk)
            odd.append((i, parts))
            missing.update(w for w in parts if w not in words)
        missing, extra = list(missing), {}
        for at in range(0, len(missing), 200_000):
            short = []
            for word in missing[at : at + 200_000]:
                piece = word.encode()
                whole = self.ranks.get(piece)
                if whole is not None:
                    words[word] = whole.to_bytes(4, "little")
                elif len(piece) <= 64:
                    short.append((word, piece))
                else:
                    extra[word] = array("I", self.merge(piece)).tobytes()
            words.update(zip((w for w, _ in short), self.merge_all([p for _, p in short])))
        for i, parts in odd:
            out[i] = b"".join([words[w] if w in words else extra[w] for w in parts])
        return out

    ODD = (lambda space: f"{space}{{2}}|^{space}|{space}$|\\x00")(r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and where each text's ids begin and end.

        A single blank between two other characters always starts a match of the pattern, so a text
        without odd white space is encoded by chunks, each with its leading blank, and each distinct
        chunk of the column once.  A text with odd white space is one chunk.
        """
        column = plain_texts(column)
        odd = pc.match_substring_regex(column, self.ODD)
        split = pc.split_pattern(pc.if_else(odd, "", column), " ")
        flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        heads = flat.take(pa.array(offsets[:-1])).to_pylist()
        if pc.any(odd).as_py():
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                heads[i] = column[i].as_py()
        coded = pc.dictionary_encode(flat)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes[offsets[:-1]] = len(coded.dictionary) + np.arange(len(heads))
        table = _word_table(_joined(" ", coded.dictionary), "\0", self.encode_chunks)
        table = pa.concat_arrays([table, pa.array(self.encode_chunks(heads), pa.large_binary())])
        return _spread(table, pa.array(codes), offsets, np.dtype("<u4"))

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text]))[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def byte_codec(path: str, pattern: str) -> BytePairCodec:
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = BytePairCodec(load_ranks(path), pattern)
    return _CODECS[path, pattern]
