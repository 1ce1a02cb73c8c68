"""SentencePiece encoding and decoding with a batched Viterbi search in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mixed

#: The vocabulary's place; every function takes another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of one numpy pass, and of the equally long parts that advance together.
PASS, TOGETHER = 1 << 21, 1 << 15

_SPACE = 0x2581  # stands for a space in pieces
_OWN = 0x110000  # stands for that very character in a text: above all code points, in no piece
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NONE = np.float64(-1e18)
_STEP = float(1 << 20)


def _coded(chars: np.ndarray) -> np.ndarray:
    return mixed(chars.astype(np.uint64) + np.uint64(0x165667B19E3779F9))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Vocabulary:
    """The pieces of a model file, and a log-probability for each.

    The file at hand has merge ranks for scores, not log-probabilities; a piece of rank r gets
    Zipf's law, -log(r + 1) - log(sum of 1 / k), and a character in no piece becomes its UTF-8 bytes at
    10 below the least. (A unigram file's own scores are log-probabilities and are kept.) Ids are those that the
    sentencepiece library gives for a unigram model with these pieces and scores, not those of the file's merges.
    """

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    special: frozenset[int]  # control pieces and the unknown piece

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        raw = np.array([model.get_score(i) for i in range(n)], dtype=np.float64)
        plain = np.array([i for i in range(n) if i not in special and not model.is_byte(i)])
        if np.all(raw[plain] == np.round(raw[plain])):
            rank = np.empty(n)
            rank[plain[np.argsort(-raw[plain], kind="stable")]] = np.arange(len(plain))
            scores = np.full(n, _NONE)
            scores[plain] = -np.log(rank[plain] + 1) - np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
        else:
            scores = raw
        # Sums of such scores have no rounding, so ties are ties wherever a word is cut: the longer last piece holds.
        scores = np.where(scores > _NONE, np.round(scores * _STEP) / _STEP, _NONE)
        return cls(pieces, scores, byte_ids, special)

    @cached_property
    def plain(self) -> np.ndarray:
        """The ids of pieces that stand for characters."""
        other = self.special | {*self.byte_ids.tolist()}
        return np.array([i for i in range(len(self.pieces)) if i not in other])

    @cached_property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self.plain)

    @cached_property
    def unknown(self) -> float:
        return float(self.scores[self.plain].min() - 10)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces, and their ids in that order."""
        hashes = np.array([self._hash(self.pieces[i]) for i in self.plain], dtype=np.uint64)
        order = np.argsort(hashes)
        return hashes[order], self.plain[order].astype(np.int32)

    @cached_property
    def leading(self) -> np.ndarray:
        """For every value of a hash's leading 20 bits, whether a piece has it: most probes end here."""
        out = np.zeros(1 << 20, dtype=bool)
        out[self.keys[0] >> np.uint64(44)] = True
        return out

    @cached_property
    def ids(self) -> dict[tuple[int, ...], int]:
        return {tuple(map(ord, self.pieces[i])): int(i) for i in self.plain}

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces])

    @cached_property
    def letters(self) -> np.ndarray:
        """The code points of every piece, filled up with -1."""
        out = np.full((len(self.pieces), self.longest), -1, dtype=np.int32)
        for i in self.plain:
            out[i, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        return out

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for c in _coded(np.array([ord(x) for x in piece])):
            h = h * _BASE + c
        return h[0]

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces in one array, with each piece's start and length."""
        byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        parts = [bytes([byte_of[i]]) if i in byte_of else b"" if i in self.special else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        lengths = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] places, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def probes(v: Vocabulary, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, id) of every piece in words that lie one after the other; room says how many characters of its word end at each one.

    For one length after the other the hashes of all substrings are made from those one shorter, and probe the sorted hashes of
    the pieces; what hits is compared character by character.
    """
    hashes, ids = v.keys
    seen, spelling = v.leading, v.letters
    code = _coded(chars)
    power = _powers(_BASE, v.longest + 1)
    h = np.zeros(len(chars), dtype=np.uint64)
    found = []
    for k in range(1, min(v.longest, int(room.max(initial=0))) + 1):
        h[k - 1 :] += code[: len(code) - k + 1] * power[k - 1]
        end = np.flatnonzero(seen[h[k - 1 :] >> np.uint64(44)] & (room[k - 1 :] >= k)) + (k - 1)
        at = np.searchsorted(hashes, h[end])
        at[at == len(hashes)] = 0
        same = hashes[at] == h[end]
        end, piece = end[same], ids[at[same]]
        same = v.sizes[piece] == k
        for t in range(k):
            same &= spelling[piece, t] == chars[end - (k - 1) + t]
        found.append((end[same], np.full(int(same.sum()), k), piece[same]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def search(scores: np.ndarray, choices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of equally long parts of words: its choices in order, flat, and how many each part has.

    scores and choices are parts x characters x lengths: what the piece of length k + 1 that ends at a character is worth, and which it is.
    best[j], of the first j characters, is the maximum over k of best[j - k] + score. All parts advance together.
    """
    n, length, widest = scores.shape
    best = np.full((n, length + widest), _NONE)
    best[:, widest - 1] = 0
    back = np.zeros((n, length + 1), dtype=np.int64)
    rows = np.arange(n)
    for j in range(1, length + 1):
        # The longest piece comes first, and holds in a tie.
        worth = best[:, j - 1 : j + widest - 1] + scores[:, j - 1, ::-1]
        back[:, j] = widest - 1 - worth.argmax(axis=1)
        worth = worth[:, ::-1]
        best[:, j + widest - 1] = worth[rows, back[:, j]]
    at = np.full(n, length)
    columns, used = [], []
    while (on := at > 0).any():
        k = back[rows, at]
        columns.append(choices[rows, at - 1, k])
        used.append(on)
        at = np.where(on, at - k - 1, 0)
    mask = np.stack(used[::-1], axis=1)
    return np.stack(columns[::-1], axis=1)[mask], mask.sum(axis=1)


def _segmented(v: Vocabulary, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids, or -1 - c for a character c in no piece, of words that lie one after the other, and how many each has.

    Words are cut where no piece spans, so a text without spaces falls into short parts as well.
    """
    total = len(chars)
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    end, size, piece = probes(v, chars, np.arange(total) - first[word] + 1)
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, end - size + 2, 1)
    np.subtract.at(change, end + 1, 1)
    opens = np.cumsum(change[:-1]) == 0  # no piece goes on from the character before
    opens[first] = True
    starts = np.flatnonzero(opens)
    width = np.diff(np.append(starts, total))
    part_of = np.cumsum(opens) - 1
    # Parts by length, and hits in the same order.
    order = np.argsort(width, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    hit_rank = rank[part_of[end]]
    by_rank = np.argsort(hit_rank, kind="stable")
    end, size, piece, hit_rank = end[by_rank], size[by_rank], piece[by_rank], hit_rank[by_rank]
    edges = np.flatnonzero(np.diff(width[order], prepend=-1))
    flat, counts = [], np.zeros(len(starts), dtype=np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        length = int(width[order[a]])
        step = max(1, TOGETHER // length)
        for c in range(a, b, step):
            group = order[c : min(b, c + step)]
            low, high = np.searchsorted(hit_rank, [c, c + len(group)])
            widest = min(v.longest, length)
            scores = np.full((len(group), length, widest), _NONE)
            choices = np.zeros(scores.shape, dtype=np.int64)
            scores[:, :, 0] = v.unknown
            choices[:, :, 0] = -1 - chars[starts[group][:, None] + np.arange(length)]
            place = hit_rank[low:high] - c, end[low:high] - starts[group][hit_rank[low:high] - c], size[low:high] - 1
            scores[place] = v.scores[piece[low:high]]
            choices[place] = piece[low:high]
            found, counts[group] = search(scores, choices)
            flat.append((np.repeat(group, counts[group]), found))
    if not flat:
        return np.zeros(0, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    part = np.concatenate([p for p, _ in flat])
    ids = np.concatenate([f for _, f in flat])[np.argsort(part, kind="stable")]
    return ids, np.bincount(word[starts], weights=counts, minlength=len(lengths)).astype(np.int64)


def _bytes(v: Vocabulary, choices: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters in no piece written as byte pieces."""
    odd = np.flatnonzero(choices < 0)
    if not len(odd):
        return choices, counts
    spelled = {c: chr(_SPACE if -1 - c == _OWN else -1 - c).encode("utf-8", "surrogatepass") for c in np.unique(choices[odd]).tolist()}
    width = np.ones(len(choices), dtype=np.int64)
    width[odd] = [len(spelled[c]) for c in choices[odd].tolist()]
    out = np.repeat(choices, width)
    out[_gathered((np.cumsum(width) - width)[odd], width[odd])] = v.byte_ids[np.frombuffer(b"".join(spelled[c] for c in choices[odd].tolist()), dtype=np.uint8)]
    word = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(word, weights=width, minlength=len(counts)).astype(np.int64)


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, flat, and how many each text has.

    A text begins with a space mark that it doesn't have itself; a space mark begins a word, and no
    piece spans two words, so words are searched apart, and each distinct one once.
    """
    sizes = np.array([len(t) + bool(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(raw):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    chars = np.where(raw == _SPACE, _OWN, np.where(raw == 0x20, _SPACE, raw))
    first = np.cumsum(sizes) - sizes
    mark = chars == _SPACE
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    begins[first[sizes > 0]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(chars)))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_coded(chars) * _powers(_BASE, len(chars)), dtype=np.uint64)])
    key = mixed((sums[starts + lengths] - sums[starts]) * _powers(_INVERSE, len(chars))[starts] + mixed(lengths.astype(np.uint64)))
    _, where, word = np.unique(key, return_index=True, return_inverse=True)
    choices, counts = _segmented(v, chars[_gathered(starts[where], lengths[where])], lengths[where])
    ids, counts = _bytes(v, choices, counts)
    ids = ids[_gathered((np.cumsum(counts) - counts)[word], counts[word])]
    text = np.searchsorted(first[sizes > 0], starts, side="right") - 1
    totals = np.zeros(len(texts), dtype=np.int64)
    totals[sizes > 0] = np.bincount(text, weights=counts[word], minlength=int((sizes > 0).sum())).astype(np.int64)
    return ids.astype(np.int32), totals


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of pieces: bytes one after the other, without the space mark that begins a text.
    Bytes that aren't UTF-8 become U+FFFD; ids outside the vocabulary are an error."""
    spelled, starts, lengths = v.spelled
    if len(ids) and (ids.min() < 0 or ids.max() >= len(starts)):
        raise ValueError("an id is outside the vocabulary")
    width = lengths[ids]
    raw = spelled[_gathered(starts[ids], width)].tobytes()
    ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(width)])[np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace"))
    return out


def _chunks(column: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """Where each numpy pass begins, and its texts."""
    begin, held, texts = 0, 0, []
    for i, x in enumerate(column):
        text = x.as_py() or ""
        if texts and held + len(text) > size:
            yield begin, texts
            begin, held, texts = i, 0, []
        texts.append(text)
        held += len(text)
    if texts:
        yield begin, texts


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs(doc_id, text, ...) as (doc_id, n_tokens, token_ids), one row each, without a shuffle.

    A null or empty text has no ids; every other decodes to exactly itself, white space and the
    space mark's own character included. Words and texts may be of any length; repeated rows
    give repeated results; an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch.column("text"), PASS):
                ids, counts = encode_texts(held.value, texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with a column `text`: what token_ids spell. Null ids spell a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    columns = [c for c in encoded.columns if c != "text"]
    schema = T.StructType([*encoded.select(*columns).schema, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            step = max(1, int(len(lists) * PASS // max(1, len(lists.flatten()))))
            for a in range(0, len(lists), step):
                part = lists.slice(a, step)
                counts = np.array([0 if x is None else x for x in part.value_lengths().to_pylist()], dtype=np.int64)
                texts = decode_ids(held.value, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                out = [t if x else None for t, x in zip(texts, part.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, step) for c in columns), pa.array(out, pa.string())], names=schema.names)

    return encoded.select(*columns).mapInArrow(run, schema)
