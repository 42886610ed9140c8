"""Token counts by a compiled finite-state transducer.

A BPE encoding is decided by neighbours: a list of tokens is the encoding of its
text exactly if every two neighbours are the encoding of theirs. So the encodings of
all prefixes of a word can be followed from left to right. A state keeps, for every
earlier place from which a token of the vocabulary may still reach beyond the
present one, the tree node of the bytes read since, the last token before that
place, and how many tokens fewer it has than the present prefix. These states are
finite in number. A transition on a byte is annotated with the tokens that the new
prefix has more than the old one (fewer, if negative), so the sum along a word is
its number of tokens; the last byte of a word leads back to the start state.

States and transitions are compiled when first met, into one flat table. Every
distinct pre-token of a slice of texts runs once, all of them side by side, a byte a
step. Pre-tokens longer than ``CHUNK`` bytes are cut into chunks. A chunk is a map of
states, with the tokens it emits: from each state that may arrive it is followed to
the state that it leaves. These maps are composed pairwise along a pre-token, in a
parallel prefix scan, which gives every chunk's arriving state and the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.pretokens import WORD_END, Cut, byte_chars, read_model
from tidemark.llm.text import _BYTE, held, slices, span_hash, totals, utf8

END = 256
_ZERO = 128  # weights are kept as bytes above this offset
CHUNK = 256
MAX_STATES = 40_000  # about 55 MB with the table; beyond it the half that is met most stays
MAX_PAIRS = 1 << 18
MAX_WORDS = 1 << 19  # pre-tokens whose ids are kept, some 25 MB


class Merges:
    """Encodings of short byte strings by merge rank, and which tokens may be neighbours."""

    def __init__(self, path: str):
        vocab, merges, special_id = read_model(path)
        self.specials = list(special_id)
        of = byte_chars()

        def symbols(token: str) -> tuple[int, ...]:
            word_end = token.endswith(WORD_END) and token != WORD_END
            body = token[: -len(WORD_END)] if word_end else token
            return tuple(of[c] for c in body) + (END,) * word_end

        self.text = {i: symbols(t) for t, i in vocab.items()}
        self.special_ids = [special_id[t] for t in self.specials]
        # With word ends, the last byte and the end are one unit from the beginning.
        self.unit = {s: i for i, s in self.text.items() if len(s) == 1 or len(s) == 2 and s[1] == END}
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pairs: dict[int, bool] = {}

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        units = [(s,) for s in symbols]
        if symbols[-1] == END:
            units[-2:] = [symbols[-2:]]
        tokens = [self.unit[u] for u in units]
        while len(tokens) > 1:
            found = [self.merge.get(p) for p in zip(tokens, tokens[1:])]
            best = min((f[0], k) for k, f in enumerate(found) if f) if any(found) else None
            if best is None:
                break
            k = best[1]
            tokens[k : k + 2] = [found[k][1]]
        return tokens

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a`` in one word; a word may begin with any (a < 0)."""
        if a < 0:
            return True
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.encode(self.text[a] + self.text[b]) == [a, b]
        return known


class Store:
    """Pre-tokens that have run, in order of their hashes, with their bytes and ids.

    Bounded: above ``most`` the half that is met most often stays.
    """

    def __init__(self, most: int):
        self.most = most
        # Row 0 is the empty pre-token, which no text has.
        self.hash = np.zeros(1, np.uint64)
        self.at, self.size, self.id_at, self.n_ids, self.met = (np.zeros(1, np.int32) for _ in range(5))
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Row of each pre-token ``raw[start:start + size]``, -1 for those not held. Bytes decide, not hashes."""
        row = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        good = (self.hash[row] == hashes) & (self.size[row] == size)
        maybe = np.flatnonzero(good)
        off = np.concatenate([[0], np.cumsum(size[maybe])])
        here = np.arange(off[-1])
        apart = raw[np.repeat(start[maybe] - off[:-1], size[maybe]) + here] != self.raw[np.repeat(self.at[row[maybe]] - off[:-1], size[maybe]) + here]
        good[maybe[np.searchsorted(off, np.flatnonzero(apart), "right") - 1]] = False
        return np.where(good, row, -1)

    def add(self, hashes: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Add pre-tokens that lie one after another in ``raw``, their ids in ``ids``."""
        order = np.argsort(hashes, kind="stable")
        place = np.searchsorted(self.hash, hashes[order])
        ends, id_ends = np.cumsum(size), np.cumsum(n_ids)
        self.hash = np.insert(self.hash, place, hashes[order])
        for name, values in (("at", len(self.raw) + ends - size), ("size", size), ("id_at", len(self.ids) + id_ends - n_ids), ("n_ids", n_ids), ("met", np.zeros_like(size))):
            setattr(self, name, np.insert(getattr(self, name), place, values[order].astype(np.int32)))
        self.raw, self.ids = np.concatenate([self.raw, raw]), np.concatenate([self.ids, ids.astype(np.int32)])

    def trim(self) -> None:
        """Forget what is met least, if too much is held. Rows found before lose their meaning."""
        if max(len(self.hash), len(self.raw) // 8, len(self.ids) // 4) <= self.most:
            return
        few = np.argsort(-self.met, kind="stable")
        few = few[: max(1, min(self.most // 2, int(np.searchsorted(np.cumsum(self.size[few]), 4 * self.most)), int(np.searchsorted(np.cumsum(self.n_ids[few]), 2 * self.most))))]
        keep = np.sort(few)
        self.raw, self.at = gathered(self.raw, self.at[keep], self.size[keep])
        self.ids, self.id_at = gathered(self.ids, self.id_at[keep], self.n_ids[keep])
        self.hash, self.size, self.n_ids, self.met = self.hash[keep], self.size[keep], self.n_ids[keep], self.met[keep] // 2


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[start:start + size]`` of all spans in a row, and where each begins."""
    ends = np.cumsum(size)
    at = ends - size
    return values[np.repeat(start - at, size) + np.arange(ends[-1] if len(ends) else 0)], at


class Transducer:
    def __init__(self, path: str, max_states: int = MAX_STATES, max_words: int = MAX_WORDS):
        self.merges = m = Merges(path)
        self.max_states = max_states
        self.store = Store(max_words)
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, s in m.text.items():
            if m.encode(s) != [i]:
                continue  # no encoding ever holds such a token
            node = 0
            for x in s:
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][x]
            self.token[node] = i
        self.length = np.zeros(max(m.text) + 1, np.int64)  # in bytes
        for i, t in m.text.items():
            self.length[i] = len(t) - (t[-1] == END)
        self.clear()

    def clear(self) -> None:
        self.column = np.full(512, -1, np.int32)
        self.symbol = [-1]
        start = ((0, -1, 0),)
        self.states, self.known, self.last = [start], {start: 0}, [-1]
        self.places: dict[tuple, tuple] = {}  # one object for equal parts of states
        self.visits = np.zeros(1024, np.int64)
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[:, 0] = (np.arange(1024) << 8) | _ZERO  # column 0 stands still

    def shrink(self) -> None:
        """Forget the half of the states that was met least; their transitions are unknown again."""
        n = len(self.states)
        visits = np.zeros(n, np.int64)
        visits[: min(n, len(self.visits))] = self.visits[:n]
        visits[0] = np.iinfo(np.int64).max
        keep = np.sort(np.argsort(-visits, kind="stable")[: max(1, self.max_states // 2)])
        to = np.full(n, -1, np.int32)
        to[keep] = np.arange(len(keep))
        table = self.table[keep]
        leads = np.array([s < 256 for s in self.symbol]).nonzero()[0]  # the other columns hold tokens
        part = table[:, leads]
        target = np.where(part >= 0, to[np.maximum(part, 0) >> 8], -1)
        table[:, leads] = np.where(target >= 0, (target << 8) | (part & 255), -1)
        self.table = table
        self.states = [self.states[k] for k in keep.tolist()]
        self.last = [self.last[k] for k in keep.tolist()]
        self.known = {s: k for k, s in enumerate(self.states)}
        self.places = {p: p for s in self.states for p in s}
        self.visits = visits[keep] // 2
        self.visits[0] = 0

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        for s in np.flatnonzero(np.bincount(symbols, minlength=512) * (self.column < 0)):
            self.column[s] = len(self.symbol)
            self.symbol.append(int(s))
        if len(self.symbol) > self.table.shape[1]:
            self.table = np.pad(self.table, ((0, 0), (0, 32)), constant_values=-1)
            return self.columns(symbols)
        return self.column[symbols]

    def compile(self, state: int, column: int) -> None:
        """Work out one transition."""
        symbol, m = self.symbol[column], self.merges
        byte, ends = symbol & 255, symbol > 255
        weight = last = None
        going = []
        for node, before, fewer in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            token = self.token[self.child[node].get(END, 0)] if ends else self.token[node]
            if weight is None and token >= 0 and m.neighbours(before, token):
                weight, last = fewer + 1, token
            if not ends and self.child[node]:
                going.append((node, before, fewer))
        if weight is None:
            raise ValueError("the vocabulary does not cover every byte")
        if ends:  # leads to the start state; the table keeps the word's last token in its place
            self.table[state, column] = (last << 8) | (weight + _ZERO)
            return
        new = tuple([self.places.setdefault(p, p) for p in [*((n, b, f - weight) for n, b, f in going), (0, last, 0)]])
        to = self.known.get(new)
        if to is None:
            to = self.known[new] = len(self.states)
            self.states.append(new)
            self.last.append(last)
            if to >= len(self.table):
                grown = np.full((len(self.table) + max(1024, len(self.table) // 8), self.table.shape[1]), -1, np.int32)
                grown[: len(self.table)] = self.table
                grown[:, 0] = (np.arange(len(grown)) << 8) | _ZERO
                self.table = grown
        self.table[state, column] = (to << 8) | (weight + _ZERO)

    def step(self, state: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Next states and weights, packed."""
        out = self.table.ravel()[state * self.table.shape[1] + columns]
        if out.min() < 0:
            lacking = out < 0
            for s, c in np.unique(np.stack([state[lacking], columns[lacking]]), axis=1).T.tolist():
                if self.table[s, c] < 0:
                    self.compile(s, c)
            out = self.table.ravel()[state * self.table.shape[1] + columns]
        return out

    def follow(self, columns: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray,
               path: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Run ``columns[start:start + size]`` from ``state``, many side by side: last state and summed weight of each.

        ``path`` takes the state after every byte or, at the end of a pre-token, its last token.
        """
        order = np.argsort(-size, kind="stable")
        start, state, going = start[order], state[order].astype(np.int64), -size[order]
        total = np.zeros(len(order), np.int64)
        for t in range(int(-going[0]) if len(going) else 0):
            n = int(np.searchsorted(going, -t, "left"))
            at = start[:n] + t
            packed = self.step(state[:n], columns[at])
            to, add = packed >> 8, (packed & 255) - _ZERO
            total[:n] += add
            state[:n] = to
            if path is not None:
                path[at] = to
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def run(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens ``raw[start:start + size]``, which lie one after another, and their numbers.

        They are read off backwards: a pre-token's last token ends it, and the state
        before a token names the one that precedes it.
        """
        if len(self.states) > self.max_states:
            self.shrink()
        end = start + size
        last = np.zeros(len(raw), bool)
        last[end - 1] = True
        columns = self.columns(raw + (last * np.int16(256)))
        path = np.empty(len(raw), np.int32)
        short = size <= CHUNK
        n_ids = np.empty(len(start), np.int64)
        n_ids[short] = self.follow(columns, start[short], size[short], np.zeros(int(short.sum()), np.int64), path)[1]
        if not short.all():
            n_ids[~short] = self.scan(columns, start[~short], end[~short], path)
        met = np.bincount(path[~last], minlength=len(self.visits))
        met[: len(self.visits)] += self.visits
        self.visits = met
        ids, last_of = np.empty(int(n_ids.sum()), np.int32), np.asarray(self.last, np.int64)
        at, out, left = end - 1, np.cumsum(n_ids) - 1, n_ids
        token = path[at].astype(np.int64)
        while len(at):
            ids[out] = token
            more = left > 1
            at, out, left = (at - self.length[token])[more], out[more] - 1, left[more] - 1
            token = last_of[path[at]]
        return ids, n_ids

    def scan(self, columns: np.ndarray, start: np.ndarray, end: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Numbers of tokens of long pre-tokens, from the composed maps of their chunks."""
        lanes = -(-(end - start) // CHUNK)
        off = np.concatenate([[0], np.cumsum(lanes)])
        place = np.arange(off[-1]) - np.repeat(off[:-1], lanes)  # of a chunk in its pre-token
        at = np.repeat(start, lanes) + place * CHUNK
        size = np.minimum(np.repeat(end, lanes) - at, CHUNK)
        # Chunks of one content have one map, with a row for each state that may arrive.
        texts = np.zeros((len(at), CHUNK + 1), np.int32)
        inside = np.arange(CHUNK) < size[:, None]
        texts[:, 1:][inside] = columns[(at[:, None] + np.arange(CHUNK))[inside]]
        texts[:, 0] = size
        _, one, content = np.unique(texts, axis=0, return_index=True, return_inverse=True)
        content = content.ravel()
        later = np.flatnonzero(place > 0)
        links = np.unique(np.stack([content[later - 1], content[later]]), axis=1)
        arriving = np.stack([np.arange(len(one)), np.zeros(len(one), np.int64)])  # content and state; any may be entered at the start
        left, emitted = self.follow(columns, at[one], size[one], arriving[1])
        while True:
            known = {pair: k for k, pair in enumerate(zip(*arriving.tolist()))}
            heads: dict[int, list[int]] = {}
            for k, c in enumerate(arriving[0].tolist()):
                heads.setdefault(c, []).append(k)
            wanted = {(b, int(left[k])) for a, b in links.T.tolist() for k in heads[a]}
            new = np.array(sorted(wanted - known.keys()), np.int64).reshape(-1, 2).T
            if not new.size:
                break
            more, more_emitted = self.follow(columns, at[one][new[0]], size[one][new[0]], new[1])
            arriving, left, emitted = np.concatenate([arriving, new], axis=1), np.concatenate([left, more]), np.concatenate([emitted, more_emitted])
        # Row k of a chunk leads to row ``to[k]`` of the next: rows are numbered over all contents.
        rows = [np.array(heads[c]) for c in range(len(one))]
        widest = max(map(len, rows))
        table, counts, rank = np.zeros((len(at), widest), np.int64), np.zeros((len(at), widest), np.int64), {}
        for c, own in enumerate(rows):
            for j, k in enumerate(own.tolist()):
                rank[k] = j
        following = np.append(content[1:], -1)
        for lane in range(len(at)):
            own, c = rows[content[lane]], int(following[lane])
            counts[lane, : len(own)] = emitted[own]
            if lane + 1 < len(at) and place[lane + 1]:
                table[lane, : len(own)] = [rank[known[c, int(left[k])]] for k in own.tolist()]
        first = np.array([rank[known[int(c), 0]] for c in content])
        step = 1
        while step < lanes.max():
            reach = np.flatnonzero(place >= step)
            through = table[reach - step]
            new_counts = counts[reach - step] + np.take_along_axis(counts[reach], through, axis=1)
            new_table = np.take_along_axis(table[reach], through, axis=1)
            table[reach], counts[reach] = new_table, new_counts
            step *= 2
        entry = first[off[:-1]]
        came = np.zeros(len(at), np.int64)
        came[later] = [arriving[1][rows[content[lane]][table[lane - 1, e]]] for lane, e in zip(later.tolist(), np.repeat(entry, lanes)[later].tolist())]
        self.follow(columns, at, size, came, path)
        return counts[off[1:] - 1, entry]

    def ids_of(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every pre-token of ``cut`` begin in ``store.ids``, and their numbers.

        Each distinct pre-token is looked up once, and runs once if it is not held.
        """
        self.store.trim()
        end = np.flatnonzero(cut.last) + 1
        start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
        size, hashes = end - start, span_hash(_BYTE[cut.raw], start, end)
        while True:
            hashes, of, which = np.unique(hashes, return_index=True, return_inverse=True)
            odd = unlike(cut.raw, start, size, of[which])
            if not len(odd):
                break
            hashes = hashes[which]
            hashes[odd] += np.uint64(1)  # its hash is taken by other bytes
        row = self.store.find(hashes, cut.raw, start[of], size[of])
        new = np.flatnonzero(row < 0)
        id_at, n_ids = self.store.id_at[row], self.store.n_ids[row]
        if len(new):
            raw, at = gathered(cut.raw, start[of[new]], size[of[new]])
            ids, n_ids[new] = self.run(raw, at, size[of[new]])
            id_at[new] = len(self.store.ids) + np.cumsum(n_ids[new]) - n_ids[new]
        self.store.met[row[row >= 0]] += np.bincount(which, minlength=len(of))[row >= 0]
        if len(new):
            self.store.add(hashes[new], raw, size[of[new]], ids, n_ids[new])
        return id_at[which], n_ids[which]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's."""
        cut = Cut(texts, self.merges.specials)
        id_at, n_ids = self.ids_of(cut)
        ids = gathered(self.store.ids, id_at, n_ids)[0]
        before = np.concatenate([[0], np.cumsum(n_ids)])
        bounds = before[words_before(cut, cut.bounds)]
        if any(cut.special):
            where = [(before[words_before(cut, p)], self.merges.special_ids[k]) for s in cut.special for p, k in s]
            ids = np.insert(ids, [w for w, _ in where], [k for _, k in where])
            bounds = bounds + np.concatenate([[0], np.cumsum([len(s) for s in cut.special])])
        return ids, bounds

    def count(self, texts: list[str]) -> np.ndarray:
        cut = Cut(texts, self.merges.specials)
        tokens = self.ids_of(cut)[1]
        return totals(tokens, words_before(cut, cut.bounds)) + np.array([len(s) for s in cut.special], np.int64)


def unlike(raw: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Spans of ``raw``, one after another, whose bytes are not those of the span ``other``."""
    odd = size != size[other]
    if not odd.any():
        at = np.repeat(start[other] - start, size)
        at += np.arange(len(at))
        apart = np.flatnonzero(raw != raw[at])
        odd[np.searchsorted(start, apart, "right") - 1] = True
    return np.flatnonzero(odd)


def words_before(cut: Cut, at: np.ndarray) -> np.ndarray:
    """How many pre-tokens end before each byte position."""
    return np.searchsorted(np.flatnonzero(cut.last) + 1, at, "right")


def transducer(path: str) -> Transducer:
    """One per worker process; what it has compiled serves later tasks of its kind."""
    return held(f"transducer {path}", lambda: Transducer(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``tokenizer`` is the path of the tokenizer's file on every executor. Strings of
    special tokens inside a text count as one token each. NULL and empty texts have
    none. Repeated rows are counted alike, NULL ids are passed through, other
    columns are not read. No shuffle.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for part in slices(batches, holding=f"transducer {tokenizer}"):
            col = part.column(1)
            tokens = machine.count([t or "" for t in col.to_pylist()])
            size = np.diff(utf8(col)[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
