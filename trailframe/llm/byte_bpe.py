"""Byte-level BPE as a transducer that is made deterministic while it runs.

Merging by rank decides locally: a list of tokens is what merging a string
gives exactly if merging any two neighbours' bytes gives these two again. So
after every byte one token alone can end there: the one that fits behind the
token that ends where it begins. The transducer carries that last token of
every place from which a longer token could still grow. What all these places
have behind them in common is certain, and is put out; the rest waits, at most
for as long as the longest token has bytes ahead.

States with equal open places are one state. States and edges are made when a
text first needs them, up to a bound. Beyond it a short piece that needs a new
edge is walked on without states, token by token; a long one begins them anew.

Decoding streams: ids give bytes, and a state machine for UTF-8 holds back the
bytes of a character that is not complete yet.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import pick
from trailframe.llm.store import give_back
from trailframe.llm.tokens import vocabulary, worker_cache

# States and neighbours that a worker keeps, and bytes of a piece that is walked without states beyond that.
MOST_STATES, MOST_PAIRS, SHORT = 60_000, 400_000, 48
# Words and matches that a worker keeps (common ones turn up early), and characters of the longest one.
MOST_WORDS, MOST_PIECES, LONG_WORD = 400_000, 200_000, 40
# Texts to a batch that a task hands on.
ROWS = 256
# Ids that are decoded at a time.
STEP = 8192


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes: lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Ids by repeated merging of the leftmost pair of least rank: the rule that the transducer is compiled from."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        best = min((r for r in pairs if r >= 0), default=-1)
        if best < 0:
            break
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes in, ids out. ``ids(data)`` is what ``merge`` gives, in time linear in ``data``."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_STATES):
        self.ranks, self.most = ranks, most
        self.bytes = {i: b for b, i in ranks.items()}
        # Prefix tree of the tokens: per byte, node to node; the token that ends at a node; whether it has further ones.
        self.kids: list[dict[int, int]] = [{} for _ in range(256)]
        self.token = [-1]
        for data, i in ranks.items():
            node = 0
            for b in data:
                nxt = self.kids[b].get(node)
                if nxt is None:
                    nxt = self.kids[b][node] = len(self.token)
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.inner = bytearray(len(self.token))
        for step in self.kids:
            for node in step:
                self.inner[node] = 1
        self.edges_of: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        """Only the first state: nothing read, every token may begin."""
        # A state: the last id put out, and the open places in order of the text, each (node of what follows it, ids that wait before it).
        self.states: list[tuple] = [(-1, ((0, ()),))]
        self.names: dict[tuple, int] = {self.states[0]: 0}
        self.edges: dict[int, tuple[int, tuple[int, ...]]] = {}

    def side(self, token: int, last: bool) -> tuple[tuple[bytes, float], ...] | None:
        """What stands at a token's last (or first) byte while it is merged, and the rank of the merge that takes it up.

        None if the token doesn't come out of merging its bytes, or not in rising order of rank.
        """
        known = self.edges_of[last].get(token, ())
        if known == ():
            parts, at, found, known = [self.bytes[token][i : i + 1] for i in range(len(self.bytes[token]))], -1 if last else 0, [], None
            floor = -1
            while len(parts) > 1:
                ranks = [self.ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
                best = min((r for r in ranks if r >= 0), default=-1)
                if best < floor or best < 0:
                    break
                floor, i, edge = best, ranks.index(best), parts[at]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[at] is not edge and parts[at] != edge:
                    found.append((edge, best))
            else:
                known = (*found, (self.bytes[token], float("inf")))
            self.edges_of[last][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps ``right`` behind ``left`` (-1: at the beginning)."""
        known = self.pairs.get((left, right))
        if known is None:
            if left < 0:
                known = merge(self.ranks, self.bytes[right]) == [right]
            else:
                known = self._apart(left, right)
            if len(self.pairs) < MOST_PAIRS:
                self.pairs[left, right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        a, b = self.side(left, True), self.side(right, False)
        if a is None or b is None:
            return merge(self.ranks, self.bytes[left] + self.bytes[right]) == [left, right]
        # Both sides merge side by side in order of rank, the left one first among equals; a merge over the
        # border comes between if it is due before what stands on either side of it is taken up.
        i = j = 0
        while True:
            (x, gone), (y, over) = a[i], b[j]
            due = self.ranks.get(x + y)
            if due is not None and due < gone and due <= over:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if gone <= over:
                i += 1
            else:
                j += 1

    def edge(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the edge of a state by one byte: the next state and the ids that have become certain."""
        root, places = self.states[state]
        step, token, inner = self.kids[byte], self.token, self.inner
        grown = [(step[node], wait) for node, wait in places if node in step]
        last = None
        for node, wait in grown:
            if token[node] >= 0 and self.fits(wait[-1] if wait else root, token[node]):
                last = (*wait, token[node])
                break
        if last is None:
            raise ValueError("the ranks lack a single byte")
        grown = [place for place in grown if inner[place[0]]]
        grown.append((0, last))
        # Ids that all open places have before them are certain.
        shared, most = 0, len(grown[0][1])
        while shared < most and all([len(wait) > shared and wait[shared] == last[shared] for _, wait in grown]):
            shared += 1
        out = last[:shared]
        if shared:
            root = out[-1]
            grown = [(node, wait[shared:]) for node, wait in grown]
        # The last certain id matters where something may follow it at once.
        name = (root if any([not wait for _, wait in grown]) else -1, tuple(grown))
        number = self.names.get(name)
        if number is None:
            number = self.names[name] = len(self.states)
            self.states.append(name)
        found = self.edges[state << 8 | byte] = (number, out)
        return found

    def end(self, state: int) -> tuple[int, ...]:
        """The ids that still wait when the text ends in this state."""
        return self.states[state][1][-1][1]

    def begins(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """The tokens that begin at a place, short ones first, each with its end."""
        kids, token, node, found = self.kids, self.token, 0, []
        for end in range(at, len(data)):
            node = kids[data[end]].get(node)
            if node is None:
                break
            if token[node] >= 0:
                found.append((token[node], end + 1))
        return found

    def walk(self, data: bytes, last: int = -1) -> list[int]:
        """The ids of a short piece behind ``last`` without states: the longest token that fits, given up for a shorter one where nothing fits behind it.

        One list of tokens alone leads to a place, so that none is entered twice.
        """
        pairs, before, out, open_, entered = self.pairs, last, [], [], bytearray(len(data) + 1)
        found = self.begins(data, 0)
        entered[0] = 1
        while not entered[-1]:
            while found:
                token, end = found.pop()
                if entered[end]:
                    continue
                fits = pairs.get((last, token))
                if self.fits(last, token) if fits is None else fits:
                    entered[end] = 1
                    out.append(token)
                    open_.append(found)
                    last, found = token, self.begins(data, end)
                    break
            else:
                if not out:
                    raise ValueError("the ranks lack a single byte")
                out.pop()
                found, last = open_.pop(), out[-1] if out else before
        return out

    def ids(self, data: bytes) -> list[int]:
        full = len(self.states) >= self.most
        if full and len(data) > SHORT:
            self.restart()
            full = False
        state, out, edges = 0, [], self.edges
        for byte in data:
            found = edges.get(state << 8 | byte)
            if found is None:
                if full:
                    # What is put out is certain: only the rest is walked.
                    return out + self.walk(data[sum([len(self.bytes[i]) for i in out]) :], out[-1]) if out else self.walk(data)
                found = self.edge(state, byte)
            state, more = found
            if more:
                out += more
        out += self.end(state)
        return out


class Utf8Machine:
    """Incremental UTF-8: ``feed`` gives the complete characters, and holds back an open one's bytes.

    States: 0 between characters, 1 to 3 bytes missing, then the four places
    where the next byte's range is narrower (no overlong forms, surrogates or
    numbers over U+10FFFF); -1 is an error, which decodes as U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def step(state: int, byte: int) -> int:
        if state == 0:
            if byte < 0x80:
                return 0
            if 0xC2 <= byte <= 0xDF:
                return 1
            if 0xE0 <= byte <= 0xEF:
                return {0xE0: 4, 0xED: 5}.get(byte, 2)
            if 0xF0 <= byte <= 0xF4:
                return {0xF0: 6, 0xF4: 7}.get(byte, 3)
            return -1
        low, high, nxt = {
            1: (0x80, 0xBF, 0),
            2: (0x80, 0xBF, 1),
            3: (0x80, 0xBF, 2),
            4: (0xA0, 0xBF, 1),
            5: (0x80, 0x9F, 1),
            6: (0x90, 0xBF, 2),
            7: (0x80, 0x8F, 2),
        }[state]
        return nxt if low <= byte <= high else -1

    def feed(self, data: bytes) -> str:
        data = self.open + data
        # The last character begins among the last four bytes.
        begin = len(data)
        for at in range(len(data) - 1, max(-1, len(data) - 5), -1):
            if not 0x80 <= data[at] <= 0xBF:
                state = 0
                for byte in data[at:]:
                    state = self.step(state, byte)
                    if state <= 0:
                        break
                begin = at if state > 0 else begin
                break
        self.open = data[begin:]
        return data[:begin].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Texts to ids and back, by a file of ranks and a pattern whose matches are encoded one by one.

    A match never goes on behind a blank that stands before a word, so texts are
    cut at such blanks and a worker keeps the ids of the words it has met. Texts
    with longer runs of white space round a blank are matched whole.
    """

    ODD = re.compile(r"\s (?=\s|\Z)")

    def __init__(self, path: str, pattern: str, most_states: int = MOST_STATES):
        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks, most_states)
        self.pattern = regex.compile(pattern)
        # Whether it does: long and short words, of one and several alphabets.
        self.plain = all(self.pattern.findall(f" {w}") == [f" {w}"] for w in ("a", "Xy", "straße", "日本語", "нетA", "s" * 300))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.bytes = [self.machine.bytes.get(i, b"") for i in range(max(self.ranks.values(), default=-1) + 1)]

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        """The one of this worker."""
        kept = worker_cache()
        if (path, pattern) not in kept:
            kept[path, pattern] = cls(path, pattern)
        return kept[path, pattern]

    def matched(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        if len(found) == 1:
            return self.piece(found[0])
        pieces, out = self.pieces, []
        for piece in found:
            ids = pieces.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= LONG_WORD and len(pieces) < MOST_PIECES:
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        # A piece that is a token itself is that token, even one that merging doesn't reach.
        rank = self.ranks.get(data)
        return array("i", self.machine.ids(data) if rank is None else [rank]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers end to end."""
        if self.ODD.search(text):
            return self.matched(text)
        head, *rest = text.split(" ")
        words = self.words
        out = [words.get(word) for word in rest]
        if None in out:
            for at, word in enumerate(rest):
                if out[at] is None:
                    # Letters alone are one match of any pattern that takes a blank and letters together.
                    out[at] = ids = self.piece(" " + word) if self.plain and word.isalpha() else self.matched(" " + word)
                    if len(word) <= LONG_WORD and len(words) < MOST_WORDS:
                        words[word] = ids
        return self.matched(head) + b"".join(out)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, some at a time; ids without bytes are an error."""
        machine, ids = Utf8Machine(), np.asarray(ids)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes)):
            raise ValueError("an id is not in the vocabulary")
        for at in range(0, len(ids), STEP):
            yield machine.feed(b"".join([self.bytes[i] for i in ids[at : at + STEP].tolist()]))
        yield machine.finish()


def encode_texts(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` of every row: ids of the whole text, as a list.

    Null and empty texts have an empty list. Null and repeated ids are rows like
    any other, further columns don't matter, an empty table gives an empty
    result. Texts of any length are encoded in linear time, whatever they hold.
    Nothing is shuffled; a lost task is run again with the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["id", "ids"])
        give_back()

    rows = pick(df, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, ranks: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, ids, text``: every list of ids as text, streamed through ``Utf8Machine``.

    A null list counts as empty. Bytes that aren't UTF-8 become U+FFFD. An id
    outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = ["".join(coder.decode(ids.values.to_numpy() if ids.is_valid else np.zeros(0, int))) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "text"])

    rows = pick(df, id=id_col, ids=ids_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, text string")


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode_texts(table(spark, sf_dir, "documents"), ranks, pattern)
    return decode_ids(coded, ranks, pattern).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
