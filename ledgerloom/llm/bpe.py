"""BPE encoding and decoding with a lexicon of frequent words.

The words of a text are what the tokenizer's pattern cuts it into. Words are counted over all
texts, and the most frequent ones, with the ids that merging gives them, are compiled into a
minimal acyclic transducer: a shared-suffix automaton whose arcs carry numbers that sum to a word's
place in the sorted lexicon, and a table of ids by place. Tasks map it into memory, walk all new
words of a chunk through it at once, and merge words it does not hold exactly.
"""

from __future__ import annotations

import base64
import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

TOKENIZER = "byte_bpe_50k.json"
LEXICON = 1 << 16    # words compiled at most
LONGEST = 32         # bytes of a word in the lexicon, so that it stays under 2 MB an id array aside
EXACT = 1 << 12      # counts told apart when the least frequent words of the lexicon are chosen
CHUNK = 1 << 22      # bytes of text encoded at once
BLOCK = 1 << 18      # pieces, or ids, spelled at once
SIGNS = frozenset(".,;:!?")
ID = "<i4"
SHORT = 32           # bytes up to which words are merged together


def byte_of_char() -> dict[str, int]:
    """Byte of each character that vocabularies of byte-level tokenizers spell it with: printable
    Latin-1 characters stand for themselves, the other bytes follow from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer:
    """Words, merges and token bytes of a byte-level BPE file as the tokenizers library has it."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        vocabulary = spec["model"]["vocab"]
        self.symbol = [vocabulary[ch] for ch in sorted(to_byte, key=to_byte.get)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocabulary.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.base = max(self.bytes) + 1
        self.rank: dict[int, int] = {}                   # of a pair of ids
        made = []                                        # id by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[a] * self.base + vocabulary[b]] = rank
            made.append(vocabulary[a + b])
        self.made, self.none = np.array([*made, -1], np.int64), len(made)
        self.pairs = np.array(sorted(self.rank) or [-1], np.int64)
        self.pair_ranks = np.array([self.rank.get(k, self.none) for k in self.pairs.tolist()])
        self.words_of = regex.compile(public_tokenizers.PATTERN).findall
        self.beyond = re.compile("[\u0378-\U0010FFFF]")    # from the first unassigned one on
        sizes = [len(self.bytes.get(i, b"")) for i in range(self.base)]
        self.spelling = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(self.base)),
                                      np.uint8)              # of every id, and where its own ends
        self.spelling_ends = np.cumsum(sizes)
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        # In Arrow's patterns: white space and then a space, or a special token.
        self.odd = "|".join([f"[{_SPACES}] ", *(
            "".join(f"\\x{{{ord(ch):x}}}" for ch in x) for x in self.special)])
        self.merged = self._published(path)

    def _published(self, path: str):
        """The merging of one word in tiktoken, where the vocabulary is published as ranks too, in
        a file beside it that gives every token the same id; else None, and words are merged here."""
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks_path):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = {b: i for i, b in self.bytes.items() if b.decode("utf-8", "replace") not in
                 self.special}
        if plain != ranks:
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})._core_bpe.encode_single_piece

    def pieces(self, text: str) -> list[str]:
        """The text in pieces, special tokens as pieces of their own. It is cut where a space
        follows something that is not white space: the pattern never joins characters across such
        a place, so the words of the text are those of its pieces in a row."""
        if not any(x in text for x in self.special):
            return _at_spaces(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*_at_spaces(text[at:m.start()]), m[0]]
            at = m.end()
        return out + _at_spaces(text[at:])

    def words(self, piece: str) -> list[str]:
        """The pattern's words of a piece. Letters, with a space before them or not, are one word,
        and a single sign after them is another. Code points that this Python has no category for
        may have another one in the pattern's library than in the tokenizer's; pieces that hold any
        are cut by the tokenizer's own."""
        plain = piece[1:] if piece[:1] == " " else piece
        if plain.isalpha():
            return [piece]
        if plain[-1:] in SIGNS and plain[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        if piece in self.special:
            return [piece]
        if not piece.isascii() and self.beyond.search(piece) and any(
                unicodedata.category(ch) == "Cn" for ch in piece):
            return [piece[s:e] for _, (s, e) in self.cutter.pre_tokenize_str(piece)]
        return self.words_of(piece)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes (ID): of all its neighbouring symbols the pair of the lowest
        rank is merged first, the leftmost of equal ones. Where tiktoken has the vocabulary it
        merges them; else short words are merged together, long ones by a queue."""
        plain = [w.encode("utf-8", "replace") for w in words]
        if self.merged:
            return [array("i", [self.special[w]] if w in self.special else
                          self.merged(b) if b else []).tobytes() for w, b in zip(words, plain)]
        short = [i for i, w in enumerate(plain)
                 if 0 < len(w) <= SHORT and words[i] not in self.special]
        out = [b""] * len(words)
        for i, ids in zip(short, self._together([plain[i] for i in short])):
            out[i] = ids
        for i in set(range(len(words))) - set(short):
            out[i] = np.array([self.special[words[i]]] if words[i] in self.special else
                              self._queued([self.symbol[b] for b in plain[i]]), ID).tobytes()
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, `none` for those that are never merged."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], self.none)

    def _together(self, words: list[bytes]) -> list[bytes]:
        """One merge in every word at a time, until no word has a pair left. Words that are done
        are set aside, so that a step costs as much as there are symbols in the others."""
        if not words:
            return []
        ids = np.array(self.symbol, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(ids), self.none)          # of a symbol with the next of its word
        rank[:-1] = np.where(owner[1:] == owner[:-1], self._ranks(ids[:-1], ids[1:]), self.none)
        done = []
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(start, len(ids)))
            best = np.minimum.reduceat(rank, start)
            if (best == self.none).any():
                ended = np.repeat(best == self.none, size)
                done.append((owner[ended], ids[ended]))
                ids, owner, rank = ids[~ended], owner[~ended], rank[~ended]
                continue
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
            ids[at] = self.made[best]
            after = np.minimum(at + 2, len(ids) - 1)
            joined = (at + 2 < len(ids)) & (owner[after] == owner[at])
            rank[at] = np.where(joined, self._ranks(ids[at], ids[after]), self.none)
            before = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            rank[before] = self._ranks(ids[before], ids[before + 1])
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, owner, rank = ids[kept], owner[kept], rank[kept]
        owner, ids = (np.concatenate(x) for x in zip(*done))
        flat = ids[np.argsort(owner, kind="stable")].astype(ID).tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _queued(self, ids: list[int]) -> list[int]:
        """Ids of one word of n symbols, in time n log n."""
        base, n = self.base, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank.get(ids[i] * base + ids[j])) is not None:
                heapq.heappush(queue, (rank, i, ids[i] * base + ids[j]))

        for i in range(n):
            offer(i)
        while queue:
            rank, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] * base + ids[j] != pair:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The tokens' bytes as texts, of which ends has the number of ids to their end; ids without
        a token give nothing, bytes that are no UTF-8 the replacement character."""
        known = (ids >= 0) & (ids < self.base)
        spelled, size = _joined(self.spelling, self.spelling_ends, np.where(known, ids, 0))
        if not known.all():
            spelled, size = spelled[np.repeat(known, size)], size * known
        return _texts(_binary(spelled, np.concatenate(([0], np.cumsum(size)))[
            np.concatenate(([0], ends))]))

    def cut(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """Pieces of texts, in two parts: places of texts, their distinct pieces, the place of each
        of their pieces among those, and how many there are to each text's end. Texts without white
        space before a space and without special tokens are cut by Arrow at every space, all others
        by pieces()."""
        odd = pc.match_substring_regex(texts, self.odd)
        where = odd.to_numpy(zero_copy_only=False)
        if not where.all():
            lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            after = flat.dictionary_encode()
            first = flat.take(pa.array(bounds[:-1])).dictionary_encode()
            codes = after.indices.to_numpy().astype(np.int64)
            codes[bounds[:-1]] = len(after.dictionary) + first.indices.to_numpy()
            pieces = pa.concat_arrays([
                pc.binary_join_element_wise("", after.dictionary, " "), first.dictionary])
            used = np.bincount(codes, minlength=len(pieces)) > 0   # not so if only a text's first
            yield (np.flatnonzero(~where), pieces.filter(pa.array(used)),
                   (np.cumsum(used) - 1)[codes], bounds[1:])
        if where.any():
            cut = [self.pieces(t) for t in texts.filter(odd).to_pylist()]
            found = pa.array([*chain(*cut)], pa.string()).dictionary_encode()
            yield (np.flatnonzero(where), found.dictionary,
                   found.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in cut]))

    def words_of_pieces(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray,
                                                         np.ndarray]:
        """Distinct words of pieces, the place of each piece's words among them, how many those are
        to each piece's end, and the pieces' order in this: those of ASCII letters come first."""
        alone = pc.match_substring_regex(pieces, "^ ?[A-Za-z]+$")
        words, sizes = [], []
        for piece in pieces.filter(pc.invert(alone)).to_pylist():
            found = self.words(piece)
            words += found
            sizes.append(len(found))
        letters = pieces.filter(alone)
        found = pa.concat_arrays([letters, pa.array(words, pa.string())]).dictionary_encode()
        order = np.argsort(~alone.to_numpy(zero_copy_only=False), kind="stable")
        return (found.dictionary, found.indices.to_numpy().astype(np.int64),
                np.cumsum([1] * len(letters) + sizes, dtype=np.int64), order)


def _at_spaces(text: str) -> list[str]:
    """The text cut before each space that follows something that is not white space."""
    if any(x in text for x in _WHITE) or not text.isascii() and _WIDE.search(text):
        cut = _AFTER_TEXT.split(text)
    else:
        cut = text.split(" ")
    return [cut[0], *[" " + p for p in cut[1:]]]


def _joined(rows: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of several values, one after the other in `rows`, in the order of places, and the
    number of values of each."""
    size = np.diff(ends, prepend=0)
    out = [rows[:0]]
    for at in range(0, len(places), BLOCK):
        some = places[at:at + BLOCK]
        n = size[some]
        shift = ends[some] - np.cumsum(n)
        out.append(rows[np.repeat(shift, n) + np.arange(n.sum())])
    return np.concatenate(out), size[places]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes as an Arrow column whose rows ends has the bounds of."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _texts(raw: pa.Array) -> pa.Array:
    """Bytes as text: nothing for nulls, the replacement character for what is no UTF-8."""
    raw = raw.fill_null(b"")
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


_SPACES = "".join(f"\\x{{{x:x}}}" for x in range(1 << 16) if chr(x).isspace())
# White space and then a space, within ASCII and beyond.
_WHITE = [ch + " " for ch in map(chr, range(128)) if ch.isspace()]
_WIDE = re.compile(r"[^\S\x00-\x7F] ")
_AFTER_TEXT = re.compile(r"(?<=\S) ")


def tokenizer(path: str | None = None) -> Tokenizer:
    """The tokenizer of this process; path names its file."""
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    return c.once(("bpe", path), lambda: Tokenizer(path))


# --- the lexicon ----------------------------------------------------------------------------

def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and finality of the states of the smallest automaton that accepts the words, which are
    sorted and distinct; state 0 is the first. Each word shares the start of the one before;
    what leaves that path is final and is joined with an equal state, if there is one."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], *arcs[state].items())
            same = known.setdefault(key, state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    return arcs, final


def compiled(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The transducer of (word, ids) in one block: lengths, then arcs by (state, byte) with where
    they lead and the number they add, finality by state, and ids by the word's place."""
    entries = sorted(entries)
    arcs, final = minimal_automaton([w for w, _ in entries])
    number = {0: 0}                      # states in use, in order of discovery
    queue = [0]
    for state in queue:
        for to in arcs[state].values():
            if to not in number:
                number[to] = len(number)
                queue.append(to)
    below: dict[int, int] = {}           # words accepted from a state on
    stack = [0]
    while stack:
        state = stack[-1]
        missing = [to for to in arcs[state].values() if to not in below]
        if missing:
            stack += missing
        else:
            below[state] = final[state] + sum(below[to] for to in arcs[state].values())
            stack.pop()
    keys, leads, adds = [], [], []
    for state in queue:
        passed = int(final[state])
        for byte, to in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | byte)
            leads.append(number[to])
            adds.append(passed)
            passed += below[to]
    sizes = [len(ids) for _, ids in entries]
    parts = [np.array(keys, np.int64), np.array(leads, np.int64), np.array(adds, np.int64),
             np.array([final[s] for s in queue], np.int64),
             np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
             np.array([i for _, ids in entries for i in ids], np.int64)]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(
        p.tobytes() for p in parts)


class Lexicon:
    """A compiled transducer, read in place."""

    def __init__(self, block: bytes | mmap.mmap):
        lengths = np.frombuffer(block, np.int64, 6)
        at = 8 * np.concatenate(([6], 6 + np.cumsum(lengths)))
        self.keys, self.leads, self.adds, self.final, self.starts, self.ids = (
            np.frombuffer(block, np.int64, n, a) for n, a in zip(lengths, at))
        self.ends = self.starts[1:]

    def places(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Place of each word in the lexicon, -1 for those it does not hold. All words walk at
        once, a byte at a time."""
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        bounds, text = (np.frombuffer(x or b"", kind) for x, kind in zip(
            words.buffers()[1:], (np.int32, np.uint8)))
        start = bounds[words.offset:words.offset + len(words)]
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.keys) else np.empty(0, np.int64)
        state[:] = 0 if len(self.keys) else -1
        step = 0
        while len(live):
            ended = size[live] == step
            live = live[~ended]
            key = state[live] << 8 | text[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            state[live] = np.where(there, self.leads[arc], -1)
            place[live] += self.adds[arc]
            live = live[there]
            step += 1
        held = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        return np.where(held, place, -1)

    def ids_of(self, places: list[int]) -> list[bytes]:
        return [self.ids[self.starts[p]:self.starts[p + 1]].astype(ID).tobytes() for p in places]


def mapped(block: bytes) -> Lexicon:
    """The lexicon, read from a mapped file that has no name left; a process that takes the place
    of a lost one maps it anew from the broadcast block."""
    with tempfile.TemporaryFile() as f:
        f.write(block)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of about CHUNK bytes."""
    for batch in batches:
        keys, raw = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.binary_length(raw).fill_null(0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            yield keys.slice(at, to - at), _texts(raw.slice(at, to - at))
            at = to


def word_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n) over all rows of docs, words of up to LONGEST bytes. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        for _, texts in _chunks(batches):
            for _, pieces, codes, _ in tk.cut(texts):
                words, places, ends, order = tk.words_of_pieces(pieces)
                n = np.bincount(codes, minlength=len(pieces))[order]
                n = np.bincount(places, np.repeat(n, np.diff(ends, prepend=0)), len(words))
                yield pa.RecordBatch.from_arrays(
                    [words.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])

    rows = docs.select(F.lit(0).alias("key"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "word binary, n long")
    return counted.where(F.octet_length("word") <= LONGEST).groupBy("word").agg(
        F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", limit: int = LEXICON, path: str | None = None
            ) -> bytes:
    """The compiled transducer of the most frequent words of docs: those that occur at least as
    often as the least count which no more than `limit` words reach, and more than once. So at most
    `limit` words of LONGEST bytes reach the driver, and a row for each of the counts up to EXACT
    and of the powers of two beyond."""
    counts = c.cut(word_counts(docs, text, path).where("n > 1"))
    n = F.col("n")
    level = F.when(n <= EXACT, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))
    words, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(),
                    key=lambda r: -r["level"]):
        words += r["k"]
        if words > limit:
            break
        least = r["level"]
    top = counts.where(n >= F.lit(least)).select("word").collect() if least else []
    c.discard(counts)
    found = [bytes(r["word"]).decode() for r in top]
    ids = (np.frombuffer(x, ID).tolist() for x in tokenizer(path).merge(found))
    return compiled([(w.encode(), x) for w, x in zip(found, ids)])


# --- encoding and decoding ------------------------------------------------------------------

class Encoder:
    """Ids of texts: of every distinct piece of a chunk once, by its words."""

    def __init__(self, tk: Tokenizer, lex: Lexicon):
        self.tk, self.lex = tk, lex

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In parts: places of texts, their ids, and how many there are to each text's end."""
        for where, pieces, codes, ends in self.tk.cut(texts):
            ids, size = _joined(*self._ids_of_pieces(pieces), codes)
            yield where, ids, np.concatenate(([0], np.cumsum(size)))[ends]

    def _ids_of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many there are to each piece's end."""
        words, places, ends, order = self.tk.words_of_pieces(pieces)
        ids, size = _joined(*self._ids_of(words), places)
        ends = np.concatenate(([0], np.cumsum(size)))[ends]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, size = _joined(ids, ends, place)
        return ids, np.cumsum(size)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words: the lexicon's ids, or those that merging gives."""
        rows = self.lex.places(words)
        unseen = np.flatnonzero(rows < 0)
        merged = self.tk.merge(words.take(pa.array(unseen)).to_pylist())
        rows[unseen] = np.arange(len(unseen)) + len(self.lex.ends)
        size = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        ids, n = _joined(np.concatenate((self.lex.ids, np.frombuffer(b"".join(merged), ID))),
                         np.concatenate((self.lex.ends, len(self.lex.ids) + np.cumsum(size))), rows)
        return ids, np.cumsum(n)


def _encoding(docs: DataFrame, block: bytes, path: str | None):
    """For tasks: keys, ids and how many ids there are to each key's end, of the (key, text) rows of
    batches, a chunk at a time. A process keeps the lexicon of one job, the last that it had a task
    of."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]
            ) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        encoder = c.newest("encoder", name, lambda: Encoder(
            tokenizer(path), mapped(shared.value)))
        for keys, texts in _chunks(batches):
            for where, ids, ends in encoder.encode(texts):
                yield keys.take(pa.array(where)), ids, ends

    return run


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                    pa.array(ids, pa.int32()))


def _key_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"),
                       F.col(text).cast("binary").alias("text"))


def encoded(docs: DataFrame, block: bytes, key: str = "doc_id", text: str = "text",
            path: str | None = None) -> DataFrame:
    """(key, ids) of every row of docs: its text's ids, special tokens told apart, none added.

    block is a lexicon() of any texts; it changes the time and not the ids. Null and empty texts
    have no ids. Keys may be null, shared or repeated. Bytes that are no UTF-8 count as the
    replacement character. A very long text is encoded whole in one task; a word of n bytes costs
    n log n. Other columns of docs are left out, whatever their names.
    """
    encoding = _encoding(docs, block, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, ends in encoding(batches):
            yield pa.RecordBatch.from_arrays([keys, _lists(ids, ends)], names=["key", "ids"])

    return _key_and_text(docs, key, text).mapInArrow(
        run, "key long, ids array<int>").withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None
            ) -> DataFrame:
    """(key, ids, text) of every row: the text that its ids spell, special tokens kept. Null ids
    are none and spell the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, tk.decode(ids, bounds[1:] - bounds[0])],
                names=["key", "ids", "text"])

    plain = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(
        F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return plain.mapInArrow(run, "key long, ids array<int>, text string").withColumnRenamed(
        "key", key)


def recoded(docs: DataFrame, block: bytes, key: str = "doc_id", text: str = "text",
            path: str | None = None) -> DataFrame:
    """(key, ids, text) of every row of docs: decoded(encoded(docs)), both by the same process, so
    that a task takes one and not two at a time."""
    encoding = _encoding(docs, block, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        for keys, ids, ends in encoding(batches):
            yield pa.RecordBatch.from_arrays([keys, _lists(ids, ends), tk.decode(ids, ends)],
                                             names=["key", "ids", "text"])

    return _key_and_text(docs, key, text).mapInArrow(
        run, "key long, ids array<int>, text string").withColumnRenamed("key", key)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids."""
    docs = c.table(spark, sf_dir, "documents")
    back = recoded(docs, lexicon(docs))
    spelled = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(spelled, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
