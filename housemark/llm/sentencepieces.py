"""SentencePiece BPE encoding and decoding by rounds of merges over flat arrays.

The distinct words of many texts lie behind each other in one array of symbols. A round finds
the lowest rank among the pairs of neighbours of every word, merges all pairs of that rank
from the left at once, and closes the gaps; words without a pair leave the array, and the
rounds end when it is empty.

The library merges one pair at a time: the best, the leftmost of equal ones. All at once is
the same unless a merged piece forms a pair that is as good or better, which the order of a
vocabulary does not rule out. Such pieces are known beforehand (``eager``). Where a word has
several pairs of the lowest rank and one makes an eager piece, the pairs of that word are
merged one after the other, each with what follows from it.

Words are cut where no piece of the vocabulary holds both neighbouring characters: no merge
crosses such a place, so long runs without spaces fall into short words too.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

MODEL = "piece_bpe_32k.model"
# How the library writes a space, unknown pieces and undecodable bytes.
SPACE = "▁"
UNKNOWN = " ⁇ "
UNDECODABLE = "�"

_CODES = 0x110000
_NONE = np.iinfo(np.int64).max
_GONE = -1
_CHARS = 1 << 20
_IDS = 1 << 18
#: Ids of words that a task remembers.
_REMEMBERED = 1 << 21
# Spaces belong to the word that follows them.
_WORD = re.compile(" *[^ ]+| +")
# Slices of a long text that end before a space.
_SLICE = re.compile("(?s).{1,1000000} *[^ ]*")


@dataclass(frozen=True)
class Vocabulary:
    """What tasks get of a model; its size is that of the vocabulary.

    ``keys`` are the pairs of ids that merge (left times ``width`` plus right, ascending),
    ``made`` the ids of the merged pieces and ``ranks`` their order. ``chars`` are the
    characters that are pieces, with ``char_ids``; ``follow`` are the pairs of them that stand
    beside each other in a piece. ``surfaces`` are the bytes of each id's text.
    """

    keys: np.ndarray
    made: np.ndarray
    ranks: np.ndarray
    eager: np.ndarray
    chars: np.ndarray
    char_ids: np.ndarray
    follow: np.ndarray
    byte_ids: np.ndarray
    surfaces: tuple[bytes, ...]
    is_byte: np.ndarray
    is_control: np.ndarray
    opens: np.ndarray

    @property
    def width(self) -> int:
        """Symbols are ids, and for unknown characters the code behind all ids."""
        return len(self.surfaces) + _CODES

    @cached_property
    def _id_of_code(self) -> np.ndarray:
        found = np.arange(_CODES) + len(self.surfaces)
        found[self.chars] = self.char_ids
        return found

    @cached_property
    def _place_of_code(self) -> np.ndarray:
        found = np.full(_CODES, len(self.chars), np.int32)
        found[self.chars] = np.arange(len(self.chars))
        return found

    @cached_property
    def _may_follow(self) -> np.ndarray:
        found = np.zeros((len(self.chars) + 1,) * 2, bool)
        found[self._place_of_code[self.follow[:, 0]], self._place_of_code[self.follow[:, 1]]] = True
        return found

    @cached_property
    def _pair(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and where each word starts in them (and the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4")
        word = np.repeat(np.arange(len(words)), sizes)
        place = self._place_of_code[codes]
        cut = (word[1:] != word[:-1]) | ~self._may_follow[place[:-1], place[1:]]
        part = np.concatenate([np.zeros(min(len(codes), 1), np.int64), np.cumsum(cut)])
        symbols, part_of = self._merge(self._id_of_code[codes], part)
        first = np.flatnonzero(np.concatenate([np.ones(min(len(codes), 1), bool), cut]))
        word = word[first][part_of]
        symbols, word = self._with_bytes(symbols, word)
        counts = np.bincount(word, minlength=len(words))
        return symbols, np.concatenate([[0], np.cumsum(counts)])

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the ids of their bytes."""
        unknown = np.flatnonzero(symbols >= len(self.surfaces))
        if not len(unknown):
            return symbols, word
        texts = [chr(x).encode() for x in (symbols[unknown] - len(self.surfaces)).tolist()]
        count = np.ones(len(symbols), np.int64)
        count[unknown] = [len(x) for x in texts]
        starts = np.cumsum(count) - count
        many = np.repeat(symbols, count)
        sizes = count[unknown]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        many[np.repeat(starts[unknown], sizes) + within] = self.byte_ids[
            np.frombuffer(b"".join(texts), np.uint8)
        ]
        return many, np.repeat(word, count)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the word of each; ``word`` ascends."""
        symbols = symbols.astype(np.int64)
        rank = np.full(len(symbols), _NONE)
        made = np.zeros(len(symbols), np.int64)
        changed = np.flatnonzero(word[1:] == word[:-1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank[changed], made[changed] = self._look_up(symbols[changed], symbols[changed + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(word)]]))
            lowest = np.minimum.reduceat(rank, starts)
            open_word = lowest < _NONE
            if not open_word.all():
                stays = np.repeat(open_word, sizes)
                done.append((symbols[~stays], word[~stays]))
                symbols, word, rank, made = (x[stays] for x in (symbols, word, rank, made))
                lowest, sizes = lowest[open_word], sizes[open_word]
                if not len(symbols):
                    break
            pairs = np.flatnonzero(rank == np.repeat(lowest, sizes))
            in_turn = self._in_turn(word[pairs], made[pairs])
            if in_turn.any():
                self._one_by_one(symbols, word, rank, pairs[in_turn])
                renewed = np.isin(word, word[pairs[in_turn]])
                pairs = pairs[~in_turn]
            else:
                renewed = np.zeros(len(symbols), bool)
            # Of pairs that overlap every second one is merged, from the left.
            opens_run = np.concatenate([[True], np.diff(pairs) != 1])[: len(pairs)]
            run = np.maximum.accumulate(np.where(opens_run, np.arange(len(pairs)), 0))
            pairs = pairs[(np.arange(len(pairs)) - run) % 2 == 0]
            symbols[pairs] = made[pairs]
            symbols[pairs + 1] = _GONE
            renewed[pairs] = True
            keep = symbols != _GONE
            symbols, word, rank, made, stale = (x[keep] for x in (symbols, word, rank, made, renewed))
            stale[:-1] |= stale[1:]
            same = np.concatenate([word[1:] == word[:-1], [False]])[: len(word)]
            rank[stale & ~same] = _NONE
            changed = np.flatnonzero(stale & same)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _in_turn(self, word: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which of the lowest pairs are in words whose pairs cannot be merged at once."""
        again = np.concatenate([word[1:] == word[:-1], [False]])[: len(word)]
        again[1:] |= again[:-1].copy()
        suspects = again & self.eager[made]
        return np.isin(word, word[suspects]) if suspects.any() else suspects

    def _one_by_one(
        self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, pairs: np.ndarray
    ) -> None:
        """Merge the lowest ``pairs`` of their words in turn; what is merged away is marked."""
        words = np.unique(word[pairs])
        lows, highs = np.searchsorted(word, words), np.searchsorted(word, words, "right")
        for low, high in zip(lows.tolist(), highs.tolist()):
            mine = pairs[np.searchsorted(pairs, low) : np.searchsorted(pairs, high)] - low
            symbols[low:high] = self._in_order(
                symbols[low:high].tolist(), mine.tolist(), int(rank[low + mine[0]])
            )

    def _in_order(self, symbols: list[int], pairs: list[int], lowest: int) -> list[int]:
        """Merge the pairs at ``pairs``, each followed by all that is as good and beside it."""
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        none = (_NONE, -1)

        def pair(at: int) -> tuple[int, int]:
            if at < 0 or after[at] == len(symbols):
                return none
            return self._pair.get(symbols[at] * self.width + symbols[after[at]], none)

        def merge(at: int, into: int) -> None:
            gone = after[at]
            symbols[at], symbols[gone] = into, _GONE
            after[at] = after[gone]
            if after[at] < len(symbols):
                before[after[at]] = at

        for at in pairs:
            if symbols[at] == _GONE or pair(at)[0] != lowest:
                continue
            merge(at, pair(at)[1])
            while True:
                left, right = pair(before[at]), pair(at)
                if min(left, right)[0] > lowest:
                    break
                if left[0] <= right[0]:
                    at = before[at]
                merge(at, pair(at)[1])
        return symbols

    @cached_property
    def _surface_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in self.surfaces])
        return np.frombuffer(b"".join(self.surfaces), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids that end at ``ends``, each without the space put before it."""
        data, starts, sizes = self._surface_bytes
        flat = bytearray()
        for at in range(0, len(ids), _IDS):
            part = ids[at : at + _IDS]
            count = sizes[part]
            shift = starts[part] - (np.cumsum(count) - count)
            flat += data[np.arange(count.sum()) + np.repeat(shift, count)].tobytes()
        offsets = np.concatenate([[0], np.cumsum(sizes[ids])])[ends].tolist()
        texts: list[str] = []
        first = low = 0
        for end, high in zip(ends.tolist(), offsets):
            texts.append(self._text(ids[first:end], flat[low:high]))
            first, low = end, high
        return texts

    def _text(self, ids: np.ndarray, flat: bytearray) -> str:
        shown = np.flatnonzero(~self.is_control[ids[:64]]) if len(ids) else ids
        if len(ids) > 64 and not len(shown):
            shown = np.flatnonzero(~self.is_control[ids])
        if len(shown) and self.opens[ids[shown[0]]]:
            flat = flat[1:]
        try:
            return flat.decode()
        except UnicodeDecodeError:
            return self._text_with_errors(ids)

    def _text_with_errors(self, ids: np.ndarray) -> str:
        """The text of ids whose bytes are no whole characters: each odd byte is marked."""
        parts: list[str] = []
        held = b""
        seen = False

        def flush() -> None:
            nonlocal held
            while held:
                size = next((k for k in range(1, 5) if _is_character(held[:k])), 0)
                parts.append(held[:size].decode() if size else UNDECODABLE)
                held = held[max(size, 1) :]

        for i in ids.tolist():
            if self.is_byte[i]:
                held += self.surfaces[i]
                continue
            flush()
            text = self.surfaces[i].decode()
            if not seen and not any(parts) and self.opens[i]:
                text, seen = text[1:], True
            parts.append(text)
        flush()
        return "".join(parts)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def read_vocabulary(path: str) -> Vocabulary:
    """The BPE model at ``path``, which has to keep white space and fall back to bytes."""
    model = sentencepiece_model_pb2.ModelProto.FromString(open(path, "rb").read())
    rules, trained = model.normalizer_spec, model.trainer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces
    plain = plain and not (rules.precompiled_charsmap or rules.remove_extra_whitespaces)
    if not plain or trained.model_type != trained.BPE or trained.treat_whitespace_as_suffix:
        raise ValueError("a BPE model that only puts a space before the text is needed")
    kinds = np.array([x.type for x in model.pieces])
    kind = type(model.pieces[0])
    if not trained.byte_fallback or np.isin(kinds, [kind.USER_DEFINED, kind.UNUSED]).any():
        raise ValueError("a model with bytes and without user-defined or unused pieces is needed")
    pieces = {x.piece: i for i, x in enumerate(model.pieces) if x.type == kind.NORMAL}
    if not set(chain.from_iterable(pieces)) <= set(pieces):
        raise ValueError("a character of a piece is no piece itself")
    # Equal scores are one rank: of such pairs the leftmost comes first.
    order = np.unique([-x.score for x in model.pieces], return_inverse=True)[1]
    width = len(model.pieces) + _CODES
    merges, follow = {}, set()
    eager = np.zeros(len(model.pieces), bool)
    for piece, made in pieces.items():
        follow.update(zip(piece, piece[1:]))
        for at in range(1, len(piece)):
            left, right = pieces.get(piece[:at]), pieces.get(piece[at:])
            if left is not None and right is not None:
                merges[left * width + right] = made
                for part in (left, right):
                    eager[part] |= order[made] <= order[part]
    if any(b == SPACE != a for a, b in follow):
        raise ValueError("a piece goes on after a space that follows a character")
    keys = np.array(sorted(merges), np.int64)
    made = np.array([merges[x] for x in keys.tolist()], np.int64)
    chars = sorted(x for x in pieces if len(x) == 1)
    is_byte = kinds == kind.BYTE
    byte_ids = np.zeros(256, np.int64)
    surfaces = []
    for i, x in enumerate(model.pieces):
        if is_byte[i]:
            byte_ids[int(x.piece[1:-1], 16)] = i
            surfaces.append(bytes([int(x.piece[1:-1], 16)]))
        elif x.type == kind.NORMAL:
            surfaces.append(x.piece.replace(SPACE, " ").encode())
        else:
            surfaces.append(UNKNOWN.encode() if x.type == kind.UNKNOWN else b"")
    return Vocabulary(
        keys=keys,
        made=made,
        ranks=order[made].astype(np.int64),
        eager=eager,
        chars=np.array([ord(x) for x in chars]),
        char_ids=np.array([pieces[x] for x in chars], np.int64),
        follow=np.array(sorted((ord(a), ord(b)) for a, b in follow)).reshape(-1, 2),
        byte_ids=byte_ids,
        surfaces=tuple(surfaces),
        is_byte=is_byte,
        is_control=kinds == kind.CONTROL,
        opens=np.array([x.type == kind.NORMAL and x.piece[0] == SPACE for x in model.pieces]),
    )


class _Numbers(dict):
    """Words numbered as they come; ``new`` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes texts and remembers the ids of words, up to ``_REMEMBERED`` ids."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self._numbers = _Numbers()
        self._ids = np.zeros(0, np.int64)
        self._starts = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text starts in them (and the end)."""
        found = [np.zeros(0, np.int32)]
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for part in _SLICE.findall(" " + text.replace(SPACE, " ")) if text else ():
                words = _WORD.findall(part)
                found.append(np.fromiter(map(self._numbers.__getitem__, words), np.int32, len(words)))
                counts[i] += len(words)
        if self._numbers.new:
            ids, starts = self._vocabulary.encode_words(self._numbers.new)
            self._starts = np.concatenate([self._starts, starts[1:] + len(self._ids)])
            self._ids = np.concatenate([self._ids, ids])
            self._numbers.new = []
        word = np.concatenate(found)
        sizes = np.diff(self._starts)[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(ends[-1]) + np.repeat(self._starts[word] - ends[:-1], sizes)
        ids = self._ids[places].astype(np.int32)
        if len(self._ids) > _REMEMBERED:
            self._forget()
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


def with_ids(
    docs: DataFrame, text: str = "text", path: str | None = None, decoded: str | None = None
) -> DataFrame:
    """``docs`` plus ``ids``, an array of the pieces of the whole text.

    With ``decoded``, a column of this name gets the text that the ids decode to, in the same
    pass. There are no ids of begin and end; none at all for a null or an empty text, which
    decode to the empty text. Columns of these names are replaced, other columns and repeated
    rows stay, an empty table gives an empty one. Texts of any length and shape end: a task
    holds about a million characters, or one text; its time grows with the characters, and for
    runs without any place to cut them also with the number of different pieces in the run.
    """
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        added.append(T.StructField(decoded, T.StringType()))
    docs = docs.drop(*(x.name for x in added))
    column = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *added])
    names = schema.names
    vocabulary = read_vocabulary(path or public_tokenizers.path(MODEL))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _parts(batch, column):
                ids, ends = encoder.encode(part.column(column).to_pylist())
                made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if decoded:
                    made.append(pa.array(vocabulary.decode(ids, ends[1:]), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    return docs.mapInArrow(add, schema)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``_CHARS`` characters, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _CHARS, "right")))
        yield batch.slice(low, high - low)
        low = high


def with_decoded(
    frame: DataFrame, ids: str = "ids", output: str = "decoded", path: str | None = None
) -> DataFrame:
    """``frame`` plus the text of its ``ids``; null or no ids give the empty text.

    A column named ``output`` is replaced. Ids have to be those of the vocabulary.
    """
    frame = frame.drop(output)
    column = frame.columns.index(ids)
    schema = T.StructType([*frame.schema.fields, T.StructField(output, T.StringType())])
    names = schema.names
    vocabulary = read_vocabulary(path or public_tokenizers.path(MODEL))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            texts = pa.array(vocabulary.decode(values, np.cumsum(counts)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names)

    return frame.mapInArrow(add, schema)
