"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list has a *sufficient lookahead*: a number of symbols such that every
token ending that far before the end of what has been read can no longer
change, whatever follows (``sufficient_lookahead`` derives it). Text is read
in segments, cut inside a word where there is no white space, and its symbols
pass through one window (``stream``): the tokens of words that are closed
there leave it, and so do those of the open last word that lie the lookahead
before its end. As words don't influence each other, the tokens of a chunk
that met before are remembered instead of sent through again. Memory is
bounded by a segment, the window and the table of chunks, not by the text.

Decoding feeds the bytes of each token to an incremental UTF-8 automaton, so
ids can arrive in any portions.

Supported tokenizer files: BPE with an end-of-word suffix, normalizers NFC,
white space to one space, lower-casing, a removing split and a byte-level map,
no post-processor, no decoder (``decode`` then joins token strings by spaces).
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 19  # characters read at a time
PORTION = 1 << 16  # symbols that enter the window at a time
HEAP_FROM = 256  # symbols from which a word in the window is merged with a heap, not in rounds with the others: the same tokens, without a round per merge
TABLE_CHARS = 6_000_000  # characters of remembered chunks before the table is emptied
NO_RANK = np.int32(2**31 - 1)
#: Separators that str.split() knows and the tokenizer's \s does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Characters that every Unicode version of the last decade classes alike: Latin, Greek, Cyrillic, common marks, CJK, Hangul.
SURE = regex.compile("[\0-\u0529\u2010-\u2027\u2030-\u205e\u20a0-\u20bd\u2190-\u23fa\u3000-\u3096\u309b-\u30ff\u4e00-\u9fd5\uac00-\ud7a3]*")
#: A place inside white-space-free text where it may be cut: no composition and no contraction reaches over it, and the classes on both sides are sure.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fd5\uac00-\ud7a3"
SIGNS = r"!-&(-/:-@\[-`{-~"
CUT = regex.compile(f"[^']{{3}}[{LETTERS}{SIGNS}0-9](?=[{LETTERS}{SIGNS}0-9])")
SAME = regex.compile(f"[{LETTERS}]{{2}}|[{SIGNS}]{{2}}")
#: Class of each byte in a lower-cased chunk: letters (a-z and the Latin-1 letters, C3 xx), marks, the chunk separator, anything else.
LETTER, MARK, SEPARATOR, OTHER = 0, 1, 2, 3
PLAIN = np.full(256, OTHER, dtype=np.int8)
PLAIN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = MARK
PLAIN[[*range(ord("a"), ord("z") + 1), 0xC3, *range(0x80, 0xC0)]] = LETTER
PLAIN[ord("\n")] = SEPARATOR


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int]], left_of: dict[int, int], length: list[int]) -> int:
    """Symbols after which a token boundary cannot move any more.

    Compare the tokenizations of one prefix under two continuations, rule by
    rule. They agree up to some boundary, which starts at the end of the
    prefix. Rule (u, v) moves it, by |u|, only if u is the last agreed token
    and v begins at the boundary in just one of the two. The next rule (u', v')
    that moves it has a lower priority, and its v' starts where u started, so u
    lies on the left spine of v'. The boundary therefore moves back by at most
    the heaviest chain of such rules, found here in one pass by priority.
    """
    best_by_left: dict[int, int] = {}
    most = 0
    for u, v in merges:
        before, node = best_by_left.get(v, 0), v
        while node in left_of:
            node = left_of[node]
            before = max(before, best_by_left.get(node, 0))
        best = length[u] + before
        if best > best_by_left.get(u, 0):
            best_by_left[u] = best
        most = max(most, best)
    return most


class _Chunks(dict):
    """White-space-free chunk -> number; an unseen chunk gets the next number."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


class Bpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *specials.values()])
        strings = [""] * self.size
        for token, i in {**vocab, **specials}.items():
            strings[i] = token
        self.pieces = [s.encode("utf-8") for s in strings]
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in symbols], dtype=np.int32)

        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        made = [vocab[a + b] for a, b in merges]
        self.ranks = {pair: r for r, pair in reversed(list(enumerate(pairs)))}
        self.made = np.array(made, dtype=np.int32)
        length = [0] * self.size
        for i in (*self.inner, *self.last):
            length[i] = 1
        left_of: dict[int, int] = {}
        for (a, b), m in zip(pairs, made, strict=True):
            if not (length[a] and length[b]) or m in left_of:
                raise ValueError("the merge list must build every token once and from earlier tokens")
            length[m], left_of[m] = length[a] + length[b], a
        self.length = length
        self._length = np.array(length, dtype=np.int64)
        self.lookahead = sufficient_lookahead(pairs, left_of, length)
        self._hash_pairs()

        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self._splitter = self._normalizer = None
        try:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self._splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
            self._normalizer = Tokenizer.from_file(path).normalizer
        except ImportError:
            pass
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._forget()

    # ----- pair table ---------------------------------------------------

    def _hash_pairs(self) -> None:
        """Open-addressing table pair -> rank, at most an eighth full."""
        bits = max(4, (8 * len(self.ranks)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        keys = np.array([a << 32 | b for a, b in self.ranks], dtype=np.int64)
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._vals = np.full(1 << bits, NO_RANK, dtype=np.int32)
        for key, slot, rank in zip(keys.tolist(), self._slot(keys).tolist(), self.ranks.values(), strict=True):
            while self._keys[slot] != -1:
                slot = (slot + 1) & int(self._mask)
            self._keys[slot], self._vals[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._vals[slot], NO_RANK)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self._mask
            found = self._keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self._vals[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    # ----- merging ------------------------------------------------------

    def _merge_words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many words at once; returns all tokens in order and their number per word."""
        word = np.repeat(np.arange(lengths.size), lengths)
        done_tokens, done_words = [], []
        for i in np.flatnonzero(lengths >= HEAP_FROM).tolist():
            done_tokens.append(np.array(self.merge_symbols(symbols[word == i].tolist()), dtype=np.int32))
            done_words.append(np.full(done_tokens[-1].size, i))
        if done_tokens:
            short = lengths[word] < HEAP_FROM
            symbols, word = symbols[short], word[short]
        while symbols.size:
            rank = np.full(symbols.size, NO_RANK, dtype=np.int32)
            same = word[:-1] == word[1:]
            at = np.flatnonzero(same)
            rank[at] = self._rank(symbols[at], symbols[at + 1])
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            sizes = np.diff(np.append(first, symbols.size))
            least = np.minimum.reduceat(rank, first)
            active = least != NO_RANK
            if not active.all():
                over = np.repeat(~active, sizes)
                done_tokens.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, rank, sizes, least = symbols[keep], word[keep], rank[keep], sizes[active], least[active]
                if not symbols.size:
                    break
            hit = rank == np.repeat(least, sizes)
            # In a run of equal overlapping pairs every second one merges, from the left.
            at = np.flatnonzero(hit)
            starts = np.concatenate(([True], np.diff(at) != 1))
            run = at[starts][np.cumsum(starts) - 1]
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(symbols.size, dtype=bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_tokens:
            return np.empty(0, np.int32), np.zeros(lengths.size, np.int64)
        tokens, words = np.concatenate(done_tokens), np.concatenate(done_words)
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=lengths.size)

    def merge_symbols(self, symbols: list[int]) -> list[int]:
        """Plain BPE of one sequence: lowest rank first, leftmost among equals."""
        token = list(symbols)
        nxt, prev = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        ranks, made = self.ranks, self.made
        heap = [(r, i) for i in range(len(token) - 1) if (r := ranks.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if token[i] < 0 or j >= len(token) or ranks.get((token[i], token[j])) != r:
                continue
            token[i], token[j] = int(made[r]), -1
            nxt[i] = k = nxt[j]
            if k < len(token):
                prev[k] = i
                if (r := ranks.get((token[i], token[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := prev[i]) >= 0 and (r := ranks.get((token[p], token[i]))) is not None:
                heapq.heappush(heap, (r, p))
        return [t for t in token if t >= 0]

    def stream(self, portions: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Symbols of any number of words, in portions with a flag at the last symbol of each word, to tokens with such flags.

        Holds one window: a portion and, of the word that is open at its end,
        what was read beyond the last stable token, that is never more than
        the lookahead and one token. The last word has to be closed.
        """
        held = np.empty(0, dtype=np.int32)
        for symbols, ends in portions:
            symbols = np.concatenate([held, symbols])
            last = held.size + np.flatnonzero(ends)
            closed = int(last[-1]) + 1 if last.size else 0
            tokens, counts = self._merge_words(symbols[:closed], np.diff(last, prepend=-1))
            closes = np.zeros(tokens.size, dtype=bool)
            closes[np.cumsum(counts) - 1] = True
            held = symbols[closed:]
            stable = held.size - self.lookahead
            if stable > 0:
                merged = np.array(self.merge_symbols(held.tolist()), dtype=np.int32)
                until = np.cumsum(self._length[merged])
                n = int(np.searchsorted(until, stable, side="right"))
                tokens, closes = np.concatenate([tokens, merged[:n]]), np.concatenate([closes, np.zeros(n, dtype=bool)])
                held = held[until[n - 1] if n else 0 :]
            if tokens.size:
                yield tokens, closes

    def _symbols(self, words: Iterable[bytes], open_end: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words as portions for ``stream``; with ``open_end`` the last one goes on after them."""
        words = list(words)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.zeros(raw.size, dtype=bool)
        ends[np.cumsum([len(w) for w in words], dtype=np.int64) - 1] = True
        if open_end:
            ends[-1:] = False
        yield from self._portions(raw, ends)

    def _portions(self, raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, raw.size, PORTION):
            byte, end = raw[at : at + PORTION], ends[at : at + PORTION]
            yield np.where(end, self.last[byte], self.inner[byte]), end

    # ----- text to ids --------------------------------------------------

    def _forget(self) -> None:
        self._chunks = _Chunks()
        self._known = self._chars = 0
        self._ids = np.empty(1 << 16, dtype=np.uint32)
        self._start = np.zeros(1 << 16, dtype=np.int64)  # of each chunk in _ids
        self._count = np.zeros(1 << 16, dtype=np.int64)
        self._used = 0

    def _learn(self) -> None:
        """Encode the chunks that were met for the first time.

        Chunks of plain letters and ASCII marks (``PLAIN``) are cut into words
        by byte class, all at once; any other chunk goes through the pattern.
        """
        new = _tail(self._chunks, self._known)
        if not new:
            return
        n, known = len(self._chunks), self._known
        while n > self._start.size:
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
            self._count = np.concatenate([self._count, np.zeros_like(self._count)])
        raw = np.frombuffer(("\n".join(new) + "\n").encode("utf-8"), dtype=np.uint8)
        self._chars += raw.size
        kind = PLAIN[raw]
        kind[1:][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = OTHER  # multiplication and division signs
        ends = np.flatnonzero(kind == SEPARATOR)
        starts = np.concatenate(([0], ends[:-1] + 1))
        odd = np.logical_or.reduceat(kind == OTHER, starts)
        number = np.repeat(np.arange(len(new)), ends - starts + 1)
        keep = ~odd[number] & (kind != SEPARATOR)
        raw, kind, number = raw[keep], kind[keep], number[keep]
        if raw.size:
            edge = np.flatnonzero((np.diff(kind) != 0) | (np.diff(number) != 0))
            last = np.append(edge, raw.size - 1)
            closed = np.zeros(raw.size, dtype=bool)
            closed[last] = True
            plain = np.flatnonzero(~odd)
            words = np.bincount(number[last], minlength=len(new))[plain]
            self._send(known + plain, words, self._portions(raw, closed))
        at = np.flatnonzero(odd)
        if at.size:
            words = [[w.encode("utf-8") for w in self._words(new[i])] for i in at.tolist()]
            self._send(known + at, np.array([len(w) for w in words]), self._symbols(w for some in words for w in some))
        self._known = n

    def _send(self, numbers: np.ndarray, words: np.ndarray, portions: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        """Send chunks of so many words each through the window and remember what leaves it."""
        parts = list(self.stream(portions))
        if not parts:
            return
        tokens, closes = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.append(0, np.flatnonzero(closes) + 1)
        self._store(numbers, tokens, np.diff(ends[np.cumsum(words)], prepend=0))

    def _store(self, numbers: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        while self._used + tokens.size > self._ids.size:
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        self._ids[self._used : self._used + tokens.size] = tokens
        self._start[numbers] = self._used + np.cumsum(counts) - counts
        self._count[numbers] = counts
        self._used += tokens.size

    def _words(self, text: str) -> list[str]:
        """Pre-tokens of normalised text.

        Scripts beyond ``SURE`` hold characters whose class differs between
        Unicode versions; there the tokenizer file's own splitter decides.
        """
        if SURE.fullmatch(text) or self._splitter is None:
            return self.word.findall(text)
        return [w for w, _ in self._splitter.pre_tokenize_str(text)]

    def _chunk_list(self, text: str) -> list[str]:
        """Normalised text without its white space."""
        if not text.isascii():
            if self._normalizer is not None and not SURE.fullmatch(text):
                return self._words(self._normalizer.normalize_str(text))
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() has a rule for the end of a word, the tokenizer has none
                text = text.replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in NOT_SPACE):
            return self.word.findall(text)
        return text.split()

    def _pieces_of(self, text: str) -> Iterator[str | int | tuple[int, int]]:
        """Text segments, cut before white space, ids of special tokens, and (start, end) of longer stretches without a place to cut."""
        spans = [(0, len(text), None)]
        if self.special is not None and any(s in text for s in self.specials):
            spans, at = [], 0
            for m in self.special.finditer(text):
                spans += [(at, m.start(), None), (0, 0, self.specials[m[0]])]
                at = m.end()
            spans.append((at, len(text), None))
        for start, end, special in spans:
            if special is not None:
                yield special
            while start < end:
                stop = min(end, start + SEGMENT)
                if stop < end:
                    cut = max(text.rfind(" ", start + 1, stop), text.rfind("\n", start + 1, stop))
                    if cut < 0:
                        after = [c for c in (text.find(" ", stop, end), text.find("\n", stop, end)) if c >= 0]
                        stop = min(after, default=end)
                        yield start, stop
                        start = stop
                        continue
                    stop = cut
                yield text[start:stop]
                start = stop

    def _stretch(self, text: str, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A long stretch as portions for ``stream``, read in segments that may end inside a word."""
        while start < end:
            found = CUT.search(text, start + SEGMENT - 4, end) if start + SEGMENT < end else None
            stop = found.end() if found else end
            words = [w.encode("utf-8") for chunk in self._chunk_list(text[start:stop]) for w in self._words(chunk)]
            yield from self._symbols(words, open_end=bool(found and SAME.match(text, stop - 1)))
            start = stop

    def encode_stream(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Ids (uint32) in portions, each with the number of its text, in order. Texts are taken together to about a segment."""
        chunks: list[str] = []
        owner: list[tuple[int, int]] = []  # (text, number of chunks), in order
        held = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal chunks, owner, held
            if self._chars > TABLE_CHARS:
                self._forget()
            codes = np.fromiter(map(self._chunks.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            self._learn()
            counts = self._count[codes]
            ids = _gather(self._ids, self._start[codes], counts)
            ends = np.concatenate(([0], np.cumsum(counts)))
            at = 0
            for text, n in owner:
                yield text, ids[ends[at] : ends[at + n]]
                at += n
            chunks, owner, held = [], [], 0

        for i, text in enumerate(texts):
            for piece in self._pieces_of(text):
                if isinstance(piece, int):
                    yield from flush()
                    yield i, np.array([piece], dtype=np.uint32)
                    continue
                if isinstance(piece, tuple):
                    yield from flush()
                    for tokens, _ in self.stream(self._stretch(text, *piece)):
                        yield i, tokens.astype(np.uint32)
                    continue
                found = self._chunk_list(piece)
                owner.append((i, len(found)))
                chunks += found
                held += len(piece)
                if held > SEGMENT:
                    yield from flush()
        yield from flush()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for i, ids in self.encode_stream(texts):
            parts[i].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in parts]

    def decoder(self) -> Decoder:
        return Decoder(self.pieces, b" ")


class Decoder:
    """Ids to text in portions: token bytes, parted by ``joiner``, run through an incremental UTF-8 automaton."""

    def __init__(self, pieces: list[bytes], joiner: bytes):
        self._pieces, self._joiner, self._begun = pieces, joiner, False
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        if not ids:
            return ""
        data = self._joiner.join(map(self._pieces.__getitem__, ids))
        if self._begun:
            data = self._joiner + data
        self._begun = True
        return self._utf8.decode(data)

    def close(self) -> str:
        return self._utf8.decode(b"", True)


def _tail(d: dict, known: int) -> list:
    """The entries that were added to ``d`` after the first ``known``."""
    new = list(islice(reversed(d), len(d) - known))
    new.reverse()
    return new


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + count]."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if ends.size else 0
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(total)]


def portions(texts: pa.Array, chars: int = SEGMENT) -> Iterator[list[str]]:
    """Texts of an Arrow column (null: empty) in lists of about ``chars`` characters."""
    held, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        held.append(text)
        size += len(text) + 64
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The encoder for a file, built once per process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col`` (array<bigint>) and, if named, their decoded text.

    Null text counts as empty and gives an empty array and an empty string.
    Every other column stays; an existing column with the new name is replaced.
    """
    from pyspark.sql import types as T

    added = {ids_col: T.ArrayType(T.LongType())} | ({decoded_col: T.StringType()} if decoded_col else {})
    schema = T.StructType([f for f in df.schema if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])
    names = [f.name for f in schema if f.name not in added]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            at = 0
            for texts in portions(batch.column(0)):
                ids = bpe.encode_many(texts)
                values = [batch.column(c + 1).slice(at, len(texts)) for c in range(len(names))]
                values.append(pa.array([x.astype(np.int64) for x in ids], type=pa.list_(pa.int64())))
                if decoded_col:
                    values.append(pa.array([_decoded(bpe, x) for x in ids], type=pa.string()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(values, names=schema.names)

    return df.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def _decoded(bpe: Bpe, ids: np.ndarray, step: int = 1 << 16) -> str:
    decoder = bpe.decoder()
    return "".join([decoder.feed(ids[i : i + step].tolist()) for i in range(0, ids.size, step)] + [decoder.close()])


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids (little-endian 32 bit) and of the decoded text (UTF-8).

    Ids and decoded text are hashed as they come, portion by portion, so a text
    of any length needs no memory beside itself and a window. Null text is
    empty; ids may be null or repeat; an empty table gives an empty result; of
    other columns none is kept, whatever their names.
    """
    import hashlib

    def run(batches):
        bpe = load(path)
        for batch in batches:
            at = 0
            for texts in portions(batch.column(1)):
                sizes = [0] * len(texts)
                states = [(hashlib.sha256(), hashlib.sha256(), bpe.decoder()) for _ in texts]
                for i, ids in bpe.encode_stream(texts):
                    sizes[i] += ids.size
                    ids_hash, text_hash, decoder = states[i]
                    ids_hash.update(ids.astype("<u4").tobytes())
                    for k in range(0, ids.size, 1 << 16):
                        text_hash.update(decoder.feed(ids[k : k + (1 << 16)].tolist()).encode("utf-8"))
                for _, text_hash, decoder in states:
                    text_hash.update(decoder.close().encode("utf-8"))
                rows = [(n, a.hexdigest(), b.hexdigest()) for n, (a, b, _) in zip(sizes, states, strict=True)]
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", "doc_id")
