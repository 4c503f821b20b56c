"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

The encoding of a piece is the one sequence of tokens in which each token
encodes to itself and every two neighbours, put together, encode to just these two.
So there is a machine that reads bytes and guesses tokens: it walks the trie
of the vocabulary and, where a token ends, may emit it if it suits the one before.
Of a prefix's hypotheses exactly one stands at a token's end.

The machine is made deterministic while it runs. A state is the set of hypotheses,
each a trie node and the tokens it has not emitted yet; a step advances all of
them and emits the tokens on which they agree. Hypotheses die when no token is as
long as what they have read, so output lags by a bounded lookahead. States and
steps are made when they have been wanted often, kept up to a bound, then dropped and made anew; before,
the rest of a short piece is walked by its hypotheses alone, depth first. The pieces of a batch
for which a step is missing are walked together, from the last token that the machine has emitted.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm.chunks import LONGEST_KEPT, PartEncoder
from apportion.llm.held import held

KEPT_STATES = 80_000
KEPT_PARTS = 200_000  # in each of two generations, as pieces are remembered too
KEPT_PIECES = 100_000  # likewise
WANTED = 30  # times that a short piece is walked without a state before a step is made for it
SIMULATED = 64  # bytes of the longest pieces of which rare ends are walked without states
TOGETHER = 128  # pieces from which on they are walked together,
AT_ONCE = 1 << 14  # and at most so many
DECODED_AT_ONCE = 4096
_NOWHERE = (None, None)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes single pieces by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_STATES):
        self.ranks, self.kept = ranks, kept
        self.words = {i: w for w, i in ranks.items()}
        # By node and byte: the node below, and the token that ends there or None.
        self.trie: list[dict[int, tuple[int, int | None]]] = [{}]
        for word, token in ranks.items():
            node = 0
            for i, byte in enumerate(word, 1):
                below, ends = self.trie[node].get(byte, (len(self.trie), None))
                if below == len(self.trie):
                    self.trie.append({})
                self.trie[node][byte] = below, token if i == len(word) else ends
                node = below
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._walk: _Walk | None = None
        self._forget()

    def _forget(self) -> None:
        # A hypothesis: trie node, the token before it or -1, tokens that wait. A state has
        # them by falling depth of their nodes; the last is the one at a token's end.
        start = ((0, -1, ()),)
        self.states: list[tuple] = [start]
        self.numbers: dict[tuple, int] = {start: 0}
        self.steps: list[dict[int, tuple | int]] = [{}]  # how often it was wanted, for a step not made yet

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            low = min((r for r in ranked if r is not None), default=None)
            if low is None:
                break
            i = ranked.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token, which are what is left without it.

        None for a single byte; (-1, -1) for a token that merging never makes.
        """
        if token in self._halves:
            return self._halves[token]
        word = self.words[token]
        found = None
        if len(word) > 1:
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                low = min((r for r in ranked if r is not None), default=token)
                if low >= token:
                    break
                i = ranked.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        self._halves[token] = found
        return found

    def _suits(self, before: int, token: int) -> bool:
        pair = (before, token)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) > 2 * self.kept:
                self._pairs.clear()
            stands = self.halves(token) != (-1, -1)
            known = self._pairs[pair] = stands and (before < 0 or self._apart(before, token))
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens.

        Undoes both tokens' merges next to the border, the latest first. While two
        parts face each other, their merge would happen if its rank comes before
        that of the merge which takes one of them away.
        """
        until = len(self.ranks) + 1  # rank at which one of the facing parts is merged
        while True:
            crossing = self.ranks.get(self.words[left] + self.words[right])
            if crossing is not None and crossing < until:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left is None and of_right is None:
                return True
            # At equal ranks the merge further left comes first.
            if of_right is None or (of_left is not None and left > right):
                until, left = left, of_left[1]
            else:
                until, right = right + 1, of_right[0]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live = []
        ended = None
        trie = self.trie
        for node, before, waiting in self.states[state]:
            below, token = trie[node].get(byte, _NOWHERE)
            if below is None:
                continue
            if trie[below]:
                live.append((below, before, waiting))
            # At most one hypothesis stands at a token's end.
            if token is not None and ended is None and self._suits(before, token):
                ended = (0, token, (*waiting, token))
        if ended is not None:
            live.append(ended)
        out: tuple[int, ...] = ()
        if live:
            # The tokens that all have in common are decided.
            first, least = live[0][2], min(len(h[2]) for h in live)
            agreed = 0
            while agreed < least and all(h[2][agreed] == first[agreed] for h in live):
                agreed += 1
            if agreed:
                out = first[:agreed]
                live = [(n, b, w[agreed:]) for n, b, w in live]
        target = tuple(live)
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
            self.steps.append({})
        made = self.steps[state][byte] = (number, out)
        return made

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.kept:
            self._forget()
        if not piece:
            return []
        out, state, at = self._read(piece)
        if at < len(piece) - 1:
            left = self._simulated(self.states[state], piece, at)
        else:
            left = self._finish(self.states[state], piece[-1])
        # None only for vocabularies in which some byte is no token by itself.
        return self.merged(piece) if left is None else out + left

    def _read(self, piece: bytes) -> tuple[list[int], int, int]:
        """What the machine emits before it misses a step or the last byte, the state it is in, and where it is."""
        out: list[int] = []
        state, steps = 0, self.steps
        for i, byte in enumerate(piece[:-1]):
            step = steps[state].get(byte, 0)
            if step.__class__ is int:
                if step < WANTED and len(piece) <= SIMULATED:
                    # Most words are met once: a step is made when it has been wanted often.
                    steps[state][byte] = step + 1
                    return out, state, i
                step = self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return out, state, len(piece) - 1

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces as 32-bit integers; what no step is made for is walked for all of them at once."""
        if len(pieces) < TOGETHER:
            return [array("I", self.encode(p)).tobytes() for p in pieces]
        if self._walk is None:
            self._walk = _Walk(self)
        out = []
        for first in range(0, len(pieces), AT_ONCE):
            out += self._encode_some(pieces[first : first + AT_ONCE])
        return out

    def _encode_some(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        rare: list[int] = []
        starts: list[int] = []
        last: list[int] = []
        words = self.words
        for k, piece in enumerate(pieces):
            if piece in self.ranks or not 1 < len(piece) <= SIMULATED:
                out[k] = array("I", self.encode(piece)).tobytes()
                continue
            if len(self.states) > self.kept:
                self._forget()
            ids, state, at = self._read(piece)
            if at == len(piece) - 1:
                left = self._finish(self.states[state], piece[-1])
                out[k] = array("I", self.merged(piece) if left is None else ids + left).tobytes()
                continue
            rare.append(k)
            if ids:
                out[k] = array("I", ids).tobytes()
                starts.append(len(b"".join([words[i] for i in ids])))
                last.append(ids[-1])
            else:
                starts.append(0)
                last.append(-1)
        rests = self._walk([pieces[k] for k in rare], np.array(starts, np.int64), np.array(last, np.int64))
        for k, rest in zip(rare, rests, strict=True):
            out[k] = array("I", self.merged(pieces[k])).tobytes() if rest is None else out[k] + rest
        return out

    def _simulated(self, hypotheses, piece: bytes, at: int) -> list[int] | None:
        """The tokens of the rest of a short piece, without making states.

        Hypotheses are followed one after another, the longest tokens first. A prefix has one
        encoding, so a place from which one of them came to nothing is not tried again.
        """
        dead: set[int] = set()
        for node, before, waiting in hypotheses:
            left = self._followed(node, before, piece, at, dead)
            if left is not None:
                return [*waiting, *left]
        return None

    def _followed(self, node: int, before: int, piece: bytes, at: int, dead: set[int]) -> list[int] | None:
        trie, pairs, ends = self.trie, self._pairs, []
        for stop, byte in enumerate(piece[at:], at + 1):
            node, token = trie[node].get(byte, _NOWHERE)
            if token is not None:
                ends.append((stop, token))
            elif node is None:
                break
        while ends:
            stop, token = ends.pop()
            if stop in dead:
                continue
            suits = pairs.get((before, token))
            if suits or (suits is None and self._suits(before, token)):
                if stop == len(piece):
                    return [token]
                left = self._followed(0, token, piece, stop, dead)
                if left is not None:
                    left.insert(0, token)
                    return left
                dead.add(stop)
        return None

    def _finish(self, hypotheses, byte: int) -> list[int] | None:
        """The tokens that are left if a piece ends with this byte.

        No state is made for it: most ends are those of one word, and would never be met again.
        """
        for node, before, waiting in hypotheses:
            token = self.trie[node].get(byte, _NOWHERE)[1]
            if token is not None and self._suits(before, token):
                return [*waiting, token]
        return None


class _Walk:
    """Walks many pieces at once as ``_followed`` walks one: the longest tokens first, back where none suits."""

    _SHIFT = 31
    _SLOTS = 18

    def __init__(self, machine: Transducer):
        self.machine = machine
        edges, below, ends = array("i"), array("i"), array("i")
        for node, steps in enumerate(machine.trie):
            for byte in sorted(steps):
                to, token = steps[byte]
                edges.append(node << 8 | byte)
                below.append(to)
                ends.append(-1 if token is None else token)
        # Sorted by node and byte, with the node below and the token that ends there or -1.
        self.edges, self.below, self.ends = (np.array(x or [-1], dtype=np.int32) for x in (edges, below, ends))
        # Two tokens that are a token when put together, whatever its own halves are.
        ranks, pairs, tokens = machine.ranks, array("q"), array("q")
        for word, token in ranks.items():
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    pairs.append(left << self._SHIFT | right)
                    tokens.append(token)
        order = np.argsort(np.array(pairs, dtype=np.int64))
        self.joined, self.joins = (np.array(x, dtype=np.int64)[order] for x in (pairs, tokens))
        # Halves of a token: -3 for a single byte, -1 for one that is never made, -2 if not known yet.
        self.halves = np.full((2, max(machine.words, default=0) + 1), -2, dtype=np.int64)
        # Pairs that were judged, each in the slot of its hash, with the answer as its last bit.
        self.judged = np.full(1 << self._SLOTS, -1, dtype=np.int64)

    def __call__(self, pieces: list[bytes], starts: np.ndarray, last: np.ndarray) -> list[bytes | None]:
        """Ids of the rest of each piece from its start on, after its last token or -1; None where there are none."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int32)
        stops = np.cumsum([len(p) for p in pieces])
        first = stops - np.diff(stops, prepend=0) + starts
        token, size, low, tried = self._tokens(data, first, stops)
        # By place: the token before it, where that begins, and the next candidate to be tried.
        before = np.full(len(data) + 1, -1, dtype=np.int64)
        begins = np.full(len(data) + 1, -1, dtype=np.int64)
        dead = np.zeros(len(data) + 1, dtype=bool)
        done = np.zeros(len(pieces), dtype=bool)
        at, live = first.copy(), np.arange(len(pieces))
        # The place after a piece is the next one's first, so the last token of each is kept by itself.
        closing, closed = np.full(len(pieces), -1, dtype=np.int64), np.full(len(pieces), -1, dtype=np.int64)
        while len(live):
            here = at[live]
            tried[here] -= 1
            spent = tried[here] < low[here]
            # Back to where the last token begins; a piece that is back at its start has no ids.
            ended = live[spent]
            dead[at[ended]] = True
            home = at[ended] == first[ended]
            at[ended[~home]] = begins[at[ended[~home]]]
            live = np.concatenate([live[~spent], ended[~home]])
            some = live[: np.count_nonzero(~spent)]
            here = at[some]
            which = tried[here]
            stop = here + size[which]
            whole = stop == stops[some]
            left = np.where(here == first[some], last[some], before[here])
            suits = whole | ~dead[stop]
            suits[suits] = self._suit(left[suits], token[which[suits]])
            some, here, which, stop, whole = (x[suits] for x in (some, here, which, stop, whole))
            closing[some[whole]], closed[some[whole]] = token[which[whole]], here[whole]
            done[some[whole]] = True
            on = ~whole
            before[stop[on]], begins[stop[on]] = token[which[on]], here[on]
            at[some[on]] = stop[on]
            live = live[~done[live]]
        return self._ways(done, first, closing, closed, before, begins)

    def _ways(self, done, first, closing, closed, before, begins) -> list[bytes | None]:
        """The tokens on the way from each start to its piece's end."""
        live = np.flatnonzero(done)
        at, rounds = closed.copy(), [(live, closing[live])]
        while len(live := live[at[live] != first[live]]):
            rounds.append((live, before[at[live]]))
            at[live] = begins[at[live]]
        owner = np.concatenate([k for k, _ in rounds[::-1]])
        ids = np.concatenate([t for _, t in rounds[::-1]])[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(4 * np.bincount(owner, minlength=len(done))).tolist()
        return [ids[i:j] if d else None for i, j, d in zip([0, *ends], ends, done.tolist(), strict=False)]

    def _tokens(self, data, first, stops) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens that begin at each place by length: ids, lengths, and where a place's begin and end."""
        until = np.repeat(stops, np.diff(stops, prepend=0))
        place = np.arange(len(data))
        place = place[place >= np.repeat(first, np.diff(stops, prepend=0))]
        node, depth, met = np.zeros(len(place), dtype=np.int32), 0, []
        while len(place):
            key = node << 8 | data[place + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            held = self.edges[at] == key
            place, at = place[held], at[held]
            depth += 1
            ends = self.ends[at] >= 0
            met.append((place[ends], self.ends[at[ends]].astype(np.int64), np.full(np.count_nonzero(ends), depth)))
            on = place + depth < until[place]
            place, node = place[on], self.below[at[on]]
        place, token, size = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.argsort(place, kind="stable")
        upto = np.cumsum(np.bincount(place, minlength=len(data) + 1))
        return token[order], size[order], np.concatenate([[0], upto[:-1]]), upto

    def _suit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_suits`` for many pairs at once; pairs are remembered until another one has their slot."""
        key = left + 1 << self._SHIFT | right
        slot = (key * -0x61C8864680B583EB >> 64 - self._SLOTS) & (1 << self._SLOTS) - 1
        known = self.judged[slot]
        out = (known & 1).astype(bool)
        fresh = np.flatnonzero(known >> 1 != key)
        if len(fresh):
            out[fresh] = found = self._judge(left[fresh], right[fresh])
            self.judged[slot[fresh]] = key[fresh] << 1 | found
        return out

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        self._learn(right)
        out = self.halves[0, right] != -1
        live = np.flatnonzero(out & (left >= 0))
        left, right = left[live], right[live]
        until = np.full(len(live), len(self.machine.ranks) + 1, dtype=np.int64)
        while len(live):
            key = left << self._SHIFT | right
            at = np.minimum(np.searchsorted(self.joined, key), max(0, len(self.joined) - 1))
            crossed = (self.joined[at] == key) & (self.joins[at] < until) if len(self.joined) else np.zeros(len(key), bool)
            out[live[crossed]] = False
            self._learn(left)
            self._learn(right)
            one, other = self.halves[0, left] == -3, self.halves[0, right] == -3
            on = ~crossed & ~(one & other)
            live, left, right, one, other = (x[on] for x in (live, left, right, one, other))
            # At equal ranks the merge further left comes first.
            of_left = other | (~one & (left > right))
            until = np.where(of_left, left, right + 1)
            left, right = np.where(of_left, self.halves[1, left], left), np.where(of_left, right, self.halves[0, right])
        return out

    def _learn(self, tokens: np.ndarray) -> None:
        fresh = tokens[self.halves[0, tokens] == -2]
        for t in np.unique(fresh).tolist() if len(fresh) else ():
            self.halves[:, t] = self.machine.halves(t) or (-3, -3)


class PieceEncoder:
    """Encodes texts; each match of the pattern is a piece of its own.

    Parts of a text differ by their punctuation more often than by their words, so short pieces are
    remembered with their ids, a bounded number in each of two generations.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_PIECES):
        self.machine, self.kept = Transducer(ranks), kept
        self._matches = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self._known
        split = [self._matches(text) for text in texts]
        met = set().union(*split)
        missing = met.difference(known)
        again = {p: i for p in missing if (i := self._older.get(p)) is not None}
        missing.difference_update(again)
        if len(known) + len(again) + len(missing) > self.kept and known:
            known.update(again)
            again = {p: known[p] for p in met - missing}
            self._older, self._known = known, {}
            known = self._known
        known.update(again)
        # In order, so that pieces that begin alike take the same way one after another.
        fresh = sorted(missing)
        known.update(zip(fresh, self.machine.encode_all([p.encode() for p in fresh]), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in missing:
            if len(piece) > LONGEST_KEPT:
                del known[piece]
        return out


def rank_encoder(ranks: dict[bytes, int], pattern: str) -> PartEncoder:
    """Encodes texts by parts, and parts by the matches of the pattern."""
    encode = PieceEncoder(ranks, pattern)
    return PartEncoder(encode, encode, KEPT_PARTS)


class StreamingDecoder:
    """Turns ids into text as they come, keeping the bytes of an unfinished character.

    ``feed`` returns the characters that are complete; bytes that are no UTF-8 are
    an error where ``errors`` is strict, else replaced as the codec does.
    """

    def __init__(self, words: dict[int, bytes], errors: str = "strict"):
        self.words = words
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.words.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def encoder_of(path: str, pattern: str) -> PartEncoder:
    """One encoder per process and vocabulary."""
    made = held("bpe")
    if (path, pattern) not in made:
        made[path, pattern] = rank_encoder(load_ranks(path), pattern)
    return made[path, pattern]


def words_of(path: str) -> dict[int, bytes]:
    """The bytes of each id, which is all that decoding needs."""
    made = held("bpe")
    if path not in made:
        made[path] = {i: w for w, i in load_ranks(path).items()}
    return made[path]


def with_ids(docs: DataFrame, path: str, pattern: str, name: str = "ids") -> DataFrame:
    """``doc_id`` and the ids of each whole text; null counts as empty."""
    arrow = pa.schema([("doc_id", pa.int64()), (name, pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder_of(path, pattern)
        for batch in batches:
            texts = ((None, x.as_py() or "") for x in batch.column(1))
            ids = [np.frombuffer(x, "<i4") for _, x in known.encoded(texts)]
            column = pa.array(ids, arrow[1].type)
            yield pa.RecordBatch.from_arrays([batch.column(0), column], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(encoded, f"doc_id bigint, `{name}` array<int>")


def decoded(table: DataFrame, path: str, digest: Callable | None = None) -> DataFrame:
    """Texts of ids: doc_id and text, or the digests of ids and texts.

    The ids are decoded in runs, as they would come from a model; a character cut
    by the end of a run is finished by the next. Null ids count as none.
    """
    fields = [("doc_id", pa.int64())]
    fields += (
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        if digest
        else [("text", pa.string())]
    )
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids.values.to_numpy() if ids.is_valid else []
                texts = _decoded_runs(words, ids)
                out.append((doc_id, *(digest(ids, texts) if digest else ("".join(texts),))))
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    schema = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in arrow)
    return table.mapInArrow(run, schema)


def _decoded_runs(words: dict[int, bytes], ids) -> Iterator[str]:
    decoder = StreamingDecoder(words)
    for i in range(0, len(ids), DECODED_AT_ONCE):
        yield decoder.feed(ids[i : i + DECODED_AT_ONCE].tolist())
    yield decoder.finish()


def digests(ids, texts: Iterator[str]) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids as 32-bit integers and of the decoded bytes."""
    whole = hashlib.sha256()
    for text in texts:
        whole.update(text.encode())
    raw = ids.astype("<u4").tobytes() if len(ids) else b""
    return len(ids), hashlib.sha256(raw).hexdigest(), whole.hexdigest()
