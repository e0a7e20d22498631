"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No vocabulary piece holds a blank mark behind another character, so merges never
cross into the next blank: a text is a sequence of words (a run of blank marks and
what follows) that are encoded independently. The different words of a run of
documents become one flat numpy array of symbols. A round takes the best merge of
each word (segmented minimum over its pairs), applies it at all its leftmost
non-overlapping places at once, drops the symbols that went, looks up only the
pairs that changed, and lets finished words leave, until no pair remains.

Merging all places at once gives what the library's one-by-one queue gives as long
as none of the pairs that a merge makes ranks as well or better. Where one does, the
places behind it wait, up to a gap that no piece is long enough to bridge; what such a
merge sets off stays within one piece's length.

A merge always makes a piece, so two characters that no piece of the vocabulary holds
side by side at that place of the text are never merged across. Words of more than
``LONG`` characters are cut there: text without blanks costs time in proportion to its
length.

Defined results: null and empty texts have no ids and decode to the empty text;
U+2581 in a text counts as a blank, as in the library; characters outside the
vocabulary become byte pieces. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklore.llm._batches import text_runs

BLANK = "▁"
_NONE = np.iinfo(np.int32).max
_PROBES = ("", " ", "a", "  a b", "été\n\t▁x", "﻿中文 \U0001f600", " " * 40 + "end ")
LONG = 64
_UNKNOWN = 1 << 24  # symbols from here on are characters outside the vocabulary


class PieceTable:
    """What the merge rounds need of a SentencePiece BPE model, read through the library."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        scores = {p: sp.get_score(i) for p, i in pieces.items()}
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank mark behind another character")
        if not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the model has no byte pieces")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = {i: p.replace(BLANK, " ").encode() for p, i in pieces.items()}
        self.surface |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        shared = np.bincount([order[s] for s in scores.values()]) > 1
        unsafe = np.zeros(size, bool)
        self.reach = max((len(p) for p in pieces if not p.startswith(BLANK)), default=1)
        self._hash_spans(pieces)
        lefts, rights, results = [], [], []
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                head, tail = p[:cut], p[cut:]
                if head in pieces and tail in pieces:
                    lefts.append(pieces[head])
                    rights.append(pieces[tail])
                    results.append(i)
                for part in (head, tail):
                    if scores.get(part, np.inf) <= scores[p]:
                        unsafe[pieces[part]] = True
        self.rank = np.full(size, _NONE, np.int32)
        for p, i in pieces.items():
            self.rank[i] = order[scores[p]]
        self.unsafe = unsafe | np.append(shared, False)[np.minimum(self.rank, len(shared))]
        self._hash_pairs(np.array(lefts, np.int64), np.array(rights, np.int64), np.array(results, np.int32))
        self.blank_period = 0
        self.blank_period = self._find_blank_period()
        for text in _PROBES:
            if self.encode_text(text) != sp.encode(text) or self.decode(sp.encode(text)) != sp.decode(sp.encode(text)):
                raise ValueError(f"the model does not encode {text!r} by plain merges")

    # which runs of characters are pieces: a bit for each hash, so that a clash only hides a cut

    _SPAN_BITS = 22
    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def _hash_spans(self, pieces: dict[str, int]) -> None:
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            if len(p) > 1:
                by_length.setdefault(len(p), []).append(p)
        self._spans = {}
        for n, own in sorted(by_length.items()):
            points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            value = np.zeros(len(points), np.uint64)
            for j in range(n):
                value = (value ^ points[:, j]) * self._FACTOR
            held = np.zeros(1 << self._SPAN_BITS, bool)
            held[(value >> np.uint64(64 - self._SPAN_BITS)).astype(np.int64)] = True
            self._spans[n] = held

    def cuts(self, word: str) -> list[str]:
        """``word`` in parts that no merge joins: no piece of the vocabulary spans a cut."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        spans = np.zeros(len(points) + 1, np.int64)  # of cut i (before character i), by differences
        value = points.astype(np.uint64) * self._FACTOR
        for n in range(2, min(len(points), max(self._spans, default=0)) + 1):
            size = len(points) - n + 1
            value = (value[:size] ^ points[n - 1 :]) * self._FACTOR
            if n in self._spans:
                at = np.flatnonzero(self._spans[n][(value >> np.uint64(64 - self._SPAN_BITS)).astype(np.int64)])
                np.add.at(spans, at + 1, 1)
                np.add.at(spans, at + n, -1)
        free = np.flatnonzero(np.cumsum(spans[:-1])[1:] == 0) + 1
        edges = [0, *free.tolist(), len(points)]
        return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    # pair -> merged piece, open addressing in flat arrays

    _BITS = 19

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def _hash_pairs(self, left: np.ndarray, right: np.ndarray, result: np.ndarray) -> None:
        keys = left << 32 | right
        self._keys, self._merged = np.full(1 << self._BITS, -1, np.int64), np.full(1 << self._BITS, -1, np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self._keys[slots[todo]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self._keys[slots[won]], self._merged[slots[won]] = keys[won], result[won]
            todo = np.setdiff1d(todo, won)
            slots[todo] = (slots[todo] + 1) & ((1 << self._BITS) - 1)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = left.astype(np.int64) << 32 | right
        slots, out = self._slot(keys), np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self._keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self._merged[slots[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            slots[todo] = (slots[todo] + 1) & ((1 << self._BITS) - 1)
        return out

    def rounds(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge to the end. ``words`` numbers the word of each symbol, ascending.
        Returns the remaining symbols and their words, in the same order."""
        done_symbols, done_words = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        sym, word = symbols, words
        made = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        made[inner] = self.merge(sym[inner], sym[inner + 1])
        rank = np.where(made >= 0, self.rank[made], _NONE)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate((starts, [len(sym)])))
            live = best < _NONE
            if not live.all():  # finished words leave
                keep = np.repeat(live, sizes)
                done_symbols.append(sym[~keep])
                done_words.append(word[~keep])
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                best, sizes = best[live], sizes[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))  # neighbours overlap: every other one
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            if self.unsafe[made[at]].any():
                at = at[self._may_merge(sym, word, made, rank, at)]
            sym = sym.copy()
            sym[at] = made[at]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            last = at[np.append(word[1:] != word[:-1], True)[at + 1]]  # the merged symbol now ends its word
            made[at], rank[at] = -1, _NONE
            ends = np.zeros(len(sym), bool)
            ends[last] = True
            sym, word, made, rank, changed, ends = (x[stay] for x in (sym, word, made, rank, changed, ends))
            redo = np.flatnonzero(changed[:-1] & (word[:-1] == word[1:]))
            gone = np.flatnonzero(changed & ends)
            made[gone], rank[gone] = -1, _NONE
            made[redo] = self.merge(sym[redo], sym[redo + 1])
            rank[redo] = np.where(made[redo] >= 0, self.rank[made[redo]], _NONE)
        symbols, words = np.concatenate([*done_symbols, sym]), np.concatenate([*done_words, word])
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def _may_merge(self, sym: np.ndarray, word: np.ndarray, made: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the places ``at`` (the best of their words, not overlapping) can be merged at once.

        A place is noisy if a pair that its merge makes, with what then stands left and right of
        it, ranks as well as itself or better. Behind a noisy place others of its word wait,
        as far as they follow each other closely enough for pieces to meet."""
        sly = np.flatnonzero(self.unsafe[made[at]])  # no pair of another piece can rank so well
        own, last = at[sly], len(sym) - 1
        new = made[own]
        left, right = np.maximum(own - 1, 0), np.minimum(own + 2, last)
        before = sym[left]
        close = (sly > 0) & (at[sly - 1] == own - 2)  # the place before has merged by then
        before = np.where(close, made[at[sly - 1]], before)
        pair_left, pair_right = self.merge(before, new), self.merge(new, sym[right])
        bad = (own > 0) & (word[left] == word[own]) & (pair_left >= 0) & (self.rank[pair_left] <= rank[own])
        bad |= (own + 2 <= last) & (word[right] == word[own]) & (pair_right >= 0) & (self.rank[pair_right] <= rank[own])
        noisy = np.zeros(len(at), bool)
        noisy[sly[bad]] = True
        if not noisy.any():
            return np.ones(len(at), bool)
        apart = np.concatenate(([True], (word[at[1:]] != word[at[:-1]]) | (at[1:] - at[:-1] > 2 * self.reach + 2)))
        heard = np.cumsum(noisy) - noisy  # noisy places before this one, in all
        return heard == np.repeat(heard[apart], np.diff(np.append(np.flatnonzero(apart), len(at))))

    def _find_blank_period(self) -> int:
        """Blank runs: with every prefix merge tied, the left end settles in pieces of one
        length before the right end is reached. Found by encoding a run, 0 if it isn't so."""
        if self.chars[ord(BLANK)] < 0:
            return 0
        lengths = [len(self.surface[i]) for i in self.encode_words([BLANK * 127])[0].tolist()]
        first = lengths[0]
        return first if lengths[:-1].count(first) >= 127 // first - 1 and lengths[0] > 1 else 0

    def encode_words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has.
        A word is given without its first blank mark."""
        joined, cut = BLANK + BLANK.join(keys), self.blank_period
        lengths = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        owner = None
        if (cut and BLANK * (4 * cut) in joined) or lengths.max(initial=0) > LONG:
            segments, owner = [], []
            for k, key in enumerate(keys):
                word = BLANK + key
                run = len(word) - len(word.lstrip(BLANK))
                whole = (run - 2 * cut) // cut if cut and run > 4 * cut else 0  # the settled part of a long blank run goes piece by piece
                rest = word[whole * cut :]
                parts = [BLANK * cut] * whole + (self.cuts(rest) if len(rest) > LONG else [rest])
                segments += parts
                owner += [k] * len(parts)
            joined = "".join(segments)
            lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sym = self.chars[points]
        sym = np.where(sym < 0, (_UNKNOWN + points).astype(np.int32), sym)
        part = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        sym, part = self.rounds(sym, part)
        sym, part = self._to_bytes(sym, part)
        return sym, np.bincount(part if owner is None else np.asarray(owner)[part], minlength=len(keys))

    def _to_bytes(self, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unknown = sym >= _UNKNOWN
        if not unknown.any():
            return sym, part
        coded = [[self.byte_ids[b] for b in chr(s - _UNKNOWN).encode()] for s in sym[unknown].tolist()]
        counts = np.ones(len(sym), np.int64)
        counts[unknown] = [len(c) for c in coded]
        out = np.repeat(sym, counts)
        out[np.repeat(unknown, counts)] = np.concatenate([np.array(c, np.int32) for c in coded])
        return out, np.repeat(part, counts)

    def encode_text(self, text: str) -> list[int]:
        if not text:
            return []
        return self.encode_words(words_of(text))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): surfaces joined, bytes as UTF-8, without the first blank."""
        data = b"".join(self.surface[i] for i in ids)
        return data.removeprefix(b" ").decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    """Words of a non-empty text, each without the one blank mark before it; further marks stay."""
    parts = text.replace(BLANK, " ").split(" ")
    if "" not in parts:
        return parts
    words, extra = [], 0
    for part in parts[:-1]:
        if part:
            words.append(BLANK * extra + part)
            extra = 0
        else:
            extra += 1
    return [*words, BLANK * extra + parts[-1]]


_TABLES: dict[str, PieceTable] = {}


def piece_table(model: bytes) -> PieceTable:
    """The table of a model, kept by the Python worker for the tasks to come."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


class WordStore:
    """Ids of the words met so far, in flat arrays; emptied when it holds ``cap`` words or 40 times as many characters."""

    def __init__(self, table: PieceTable, cap: int = 300_000):
        self.table, self.cap = table, cap
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.flat, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a sequence of words, and the number of ids of each word."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            size = sum(map(len, fresh))
            if self.index and (len(self.index) + len(fresh) > self.cap or self.held + size > 40 * self.cap):
                self._empty()
                return self.encode(words)
            flat, counts = self.table.encode_words(fresh)
            self.held += size
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.flat, self.counts = np.concatenate((self.flat, flat)), np.concatenate((self.counts, counts))
            at[missing] = np.fromiter(map(self.index.__getitem__, map(words.__getitem__, missing.tolist())), np.int64, len(missing))
        counts = self.counts[at]
        starts = (np.cumsum(self.counts) - self.counts)[at]
        places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return self.flat[places], counts


_STORES: dict[str, WordStore] = {}
_RUN = 2 << 20


def _encoder(model, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model.value)
        store = _STORES.setdefault(hashlib.sha256(model.value).hexdigest(), WordStore(table))
        listed = [str(i) for i in range(len(table.rank))]
        surface = [table.surface.get(i, b"") for i in range(len(table.rank))]
        for batch in batches:
            counts, digests, decoded, flat = [], [], [], [np.empty(0, np.int32)]
            for _, _, texts in text_runs(batch, _RUN):
                documents = [words_of(t) if t else [] for t in texts]
                ids, per_word = store.encode([w for words in documents for w in words])
                stops = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum([len(d) for d in documents])].tolist()
                numbers, start = ids.tolist(), 0
                for stop in stops:
                    own = numbers[start:stop]
                    counts.append(stop - start)
                    digests.append(hashlib.sha256(",".join(map(listed.__getitem__, own)).encode()).hexdigest())
                    text = b"".join(map(surface.__getitem__, own)).removeprefix(b" ").decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    start = stop
                if with_ids:
                    flat.append(ids)
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat))))
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, *columns], [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
            )

    return encode


def encode_pieces(docs: DataFrame, model_path: str, with_ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids``.

    The model file is read on the driver and sent as a broadcast (its size is fixed,
    under 1 MB), so executors need no file.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    out = f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(_encoder(model, with_ids), out)


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("piece_bpe_32k.model"))
