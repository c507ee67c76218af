"""A deterministic automaton over tokens, compiled from the merges of a byte-level BPE vocabulary.

The automaton starts as one state with a loop for every byte; it accepts every token sequence of single
bytes. Merges are taken in their order. The gadget of merge (u, v) = t: the u-arcs lead to a new state,
a copy of the state they led to without its v-arc, so u followed by v is no longer accepted; every state
with a u-arc gets a t-arc to where the v-arc led. After all merges exactly one token sequence is
accepted for any bytes: their BPE tokens.

All arcs of a label lead to one state, and a copy differs from its origin by one missing arc, so the
automaton is held as a tree of copies with one removal per state, not as states times labels. Does a state
have a t-arc? It must not lack t, nor the left part of t at the time t was made, nor that part's left
part, down to a byte; one search per part in the removals, ordered by label and place in the tree.

``Automaton`` is a few arrays (about 3 MB for 50,000 merges), compiled once and sent to the tasks.
"""

from __future__ import annotations

import functools
import json
from bisect import bisect_right

import numpy as np

from opslens.llm.textnum import Spans

# pieces of up to so many bytes are encoded side by side, longer ones one after the other
SIDE_BY_SIDE = 48
LETTER, NUMBER, BLANK, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_NOW = np.iinfo(np.int32).max


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible letter."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(token: str, letters: dict[str, int]) -> bytes:
    """The bytes of a vocabulary entry; one with other letters (a special token) stands for itself."""
    if all(c in letters for c in token):
        return bytes(letters[c] for c in token)
    return token.encode()


class Automaton:
    """Compiled merges. ``labels`` are the bytes of every id, special tokens included."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[bytes, int]):
        """``merges`` are (left id, right id, id of the whole) in their order."""
        self.special = special
        self.pool = np.frombuffer(b"".join(labels), np.uint8)
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        self._compile(len(labels), merges)
        joined = {t for _, _, t in merges}
        base = [i for i, x in enumerate(labels) if len(x) == 1 and i not in joined]
        self._build_trie(labels, base + sorted(joined))

    def _compile(self, n: int, merges: list[tuple[int, int, int]]) -> None:
        left = np.full(n, -1, np.int32)
        made = np.full(n, -1, np.int32)
        target = [0] * n
        parent, removed, when = [-1], [-1], [-1]
        for k, (u, v, t) in enumerate(merges):
            # the parts of v from the whole to its first byte, with the time each had to be there
            spine, part, bound = {}, v, k
            while part >= 0:
                spine[part] = bound
                bound, part = int(made[part]), int(left[part])
            state = q = target[u]
            while state > 0 and not (removed[state] in spine and when[state] <= spine[removed[state]]):
                state = parent[state]
            left[t], made[t] = u, k
            target[t] = target[v]
            if state > 0:
                continue  # u is never followed by v: the merge has nothing to join
            parent.append(q)
            removed.append(v)
            when.append(k)
            target[u] = len(parent) - 1
        self.left, self.made = left, made
        children: list[list[int]] = [[] for _ in parent]
        for i, p in enumerate(parent[1:], 1):
            children[p].append(i)
        enter, leave = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        clock, stack = 0, [(0, False)]
        while stack:
            node, done = stack.pop()
            if done:
                leave[node] = clock - 1
                continue
            enter[node] = clock
            clock += 1
            stack.append((node, True))
            stack.extend((c, False) for c in children[node])
        # the state each token leads to, by its place in the tree; the start is place 0
        self.state = enter[np.array(target)]
        label, at = np.array(removed[1:], np.int64), np.arange(1, len(parent))
        key = label << 32 | enter[at]
        order = np.argsort(key)
        self.removal = key[order]
        self.removal_leave = leave[at][order]
        self.removal_time = np.array(when[1:], np.int64)[order]
        self.ever_removed = np.zeros(n, bool)
        self.ever_removed[label] = True

    def _build_trie(self, labels: list[bytes], usable: list[int]) -> None:
        arcs: dict[int, int] = {}
        token = [-1]
        for i in usable:
            node = 0
            for b in labels[i]:
                node = arcs.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.trie_token = np.array(token, np.int32)
        self.arc_key = np.fromiter(arcs, np.int64, len(arcs))
        self.arc_to = np.fromiter(arcs.values(), np.int32, len(arcs))
        self._lay_rows()

    def _lay_rows(self) -> None:
        """One table for all rows of transitions, each moved to where its entries find free slots: the entry of
        a node and a byte is at base + byte if that slot belongs to the node."""
        order = np.argsort(self.arc_key)
        key, to = self.arc_key[order], self.arc_to[order]
        node, byte = key >> 8, key & 255
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        count = np.diff(np.append(first, len(node)))
        single = count == 1
        # rows of several bytes go where the cursor finds room for them; it never goes back, so this is linear
        cursor, taken, bases = 256, set(), np.zeros(len(first), np.int64)
        for k in np.flatnonzero(~single)[np.argsort(-count[~single], kind="stable")].tolist():
            mine = byte[first[k] : first[k] + count[k]].tolist()
            while any(cursor + x - mine[0] in taken for x in mine):
                cursor += 1
            bases[k] = cursor - mine[0]
            taken.update(cursor + x - mine[0] for x in mine)
        # rows of one byte fill the gaps
        used = np.zeros(max(taken, default=0) + int(single.sum()) + 513, bool)
        used[list(taken)] = True
        alone = np.flatnonzero(single)
        bases[alone] = np.flatnonzero(~used[256:])[: len(alone)] + 256 - byte[first[alone]]
        self.base = np.zeros(len(self.trie_token), np.int32)
        self.base[node[first]] = bases
        slots = np.repeat(bases, count) + byte
        self.owner = np.full(int(slots.max(initial=0)) + 257, -1, np.int32)
        self.to = self.owner.copy()
        self.owner[slots] = node
        self.to[slots] = to

    def accepts(self, place: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states at these places have arcs of these labels."""
        good = np.ones(len(token), bool)
        rows = np.arange(len(token))
        bound = np.full(len(token), _NOW, np.int64)
        while len(rows):
            some = np.flatnonzero(self.ever_removed[token])
            label, at = token[some].astype(np.int64), place[some]
            i = np.searchsorted(self.removal, label << 32 | at, side="right") - 1
            bad = some[(i >= 0) & (self.removal[i] >> 32 == label) & (self.removal_leave[i] >= at) & (self.removal_time[i] <= bound[some])]
            good[rows[bad]] = False
            keep = self.left[token] >= 0
            keep[bad] = False
            keep = np.flatnonzero(keep)
            token = token[keep]
            rows, place, bound, token = rows[keep], place[keep], self.made[token], self.left[token]
        return good

    def _steps(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Last token of every beginning of every piece: (piece, bytes read)."""
        width = int(length.max())
        last = np.full((len(start), width + 1), -1, np.int32)
        for at in range(width):
            piece = np.flatnonzero(length > at)
            place = self.state[last[piece, at]] if at else np.zeros(len(piece), np.int64)
            node = np.zeros(len(piece), np.int32)
            for end in range(at, width):
                slot = self.base[node] + data[start[piece] + end]
                alive = np.flatnonzero(self.owner[slot] == node)
                piece, place, node = piece[alive], place[alive], self.to[slot[alive]]
                token = self.trie_token[node]
                whole = np.flatnonzero(token >= 0)
                whole = whole[self.accepts(place[whole], token[whole])]
                last[piece[whole], end + 1] = token[whole]
                more = length[piece] > end + 1
                piece, place, node = piece[more], place[more], node[more]
                if not len(piece):
                    break
        return last

    @functools.cached_property
    def _lists(self):
        arcs = dict(zip(self.arc_key.tolist(), self.arc_to.tolist()))
        names = ("trie_token", "state", "left", "made", "removal", "removal_leave", "removal_time")
        return arcs, *[getattr(self, n).tolist() for n in names]

    def long_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece of any length, one byte after the other."""
        arcs, tokens, states, left, made, removal, leave, times = self._lists
        known: dict[int, bool] = {}
        last = np.full(len(piece) + 1, -1, np.int32)
        for at in range(len(piece)):
            before = int(last[at]) if at else -1
            node = 0
            for end in range(at, len(piece)):
                node = arcs.get(node << 8 | piece[end], -1)
                if node < 0:
                    break
                token = tokens[node]
                if token < 0:
                    continue
                pair = (before + 1) << 32 | token
                good = known.get(pair)
                if good is None:
                    place = states[before] if at else 0
                    part, bound, good = token, _NOW, True
                    while part >= 0 and good:
                        i = bisect_right(removal, part << 32 | place) - 1
                        good = not (i >= 0 and removal[i] >> 32 == part and leave[i] >= place and times[i] <= bound)
                        bound, part = made[part], left[part]
                    if len(known) > 1_000_000:
                        known.clear()
                    known[pair] = good
                if good:
                    last[end + 1] = token
        out, at = [], len(piece)
        while at:
            out.append(int(last[at]))
            at -= int(self.sizes[out[-1]])
        return out[::-1]

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, back to back, and how many each has. Equal pieces are encoded once."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, some, which = np.unique(Spans(data)(start, end), return_index=True, return_inverse=True)
        begin, length = start[some], (end - start)[some]
        count = np.zeros(len(some), np.int64)
        found = []  # (pieces, ids from the last to the first)
        order = np.argsort(length, kind="stable")
        short = order[: np.searchsorted(length[order], SIDE_BY_SIDE, side="right")]
        at = 0
        while at < len(short):
            # widths that differ by half at most go together
            widest = max(8, int(length[short[at]]) * 3 // 2)
            to = int(np.searchsorted(length[short], widest, side="right"))
            group = short[at:to]
            last = self._steps(data, begin[group], length[group])
            piece, left = np.arange(len(group)), length[group].copy()
            while len(piece):
                token = last[piece, left[piece]]
                found.append((group[piece], token))
                count[group[piece]] += 1
                left[piece] -= self.sizes[token]
                piece = piece[left[piece] > 0]
            at = to
        for i in order[len(short) :].tolist():
            ids = self.long_piece(data[begin[i] : begin[i] + length[i]].tobytes())[::-1]
            found.append((np.full(len(ids), i), np.array(ids, np.int32)))
            count[i] = len(ids)
        owner, ids = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        pool = ids[::-1][np.argsort(owner[::-1], kind="stable")]
        n = count[which]
        return pool[spread(np.cumsum(count)[which] - n, n)], n

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc labels of the ids, back to back, and the size of each."""
        n = self.sizes[ids]
        return self.pool[spread(self.heads[ids], n)], n


def spread(head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers head, head + 1, ... of each row, ``n`` of them."""
    ends = np.cumsum(n)
    return np.repeat(head - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def load(path: str) -> tuple[Automaton, "Splitter"]:
    """Automaton and splitter of a byte-level vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    letters = byte_of_letter()
    vocab = dict(model["vocab"])
    special = {}
    for extra in spec["added_tokens"]:
        if extra["single_word"] or extra["lstrip"] or extra["rstrip"]:
            raise ValueError(f"{path}: added tokens that depend on their neighbours are not supported")
        vocab[extra["content"]] = extra["id"]
        special[extra["content"].encode()] = extra["id"]
    labels = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        labels[i] = token_bytes(token, letters)
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], special), Splitter()


class Splitter:
    """Cuts texts into pieces as the library's byte-level splitting does.

    Pieces are runs of letters, of numbers or of other signs, each with one space before it if there
    is one; the endings 's 't 're 've 'm 'll 'd where a piece would start with the apostrophe; and what
    is left of blanks. Classes of characters beyond Latin-1 are asked of the library, once each.
    """

    def __init__(self):
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.asked = None

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self.__init__()

    def _ask(self, points: np.ndarray) -> None:
        if self.asked is None:
            from tokenizers import pre_tokenizers

            self.asked = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        for p in points.tolist():
            joins = [len(self.asked.pre_tokenize_str(c + chr(p))) == 1 for c in "a1!"]
            self.kinds[p] = joins.index(True) if any(joins) else 3
        # the order of the three asked, then blanks
        self.kinds[points] = np.array([LETTER, NUMBER, OTHER, BLANK], np.uint8)[self.kinds[points]]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte start of every piece, and where each text's pieces begin; a piece ends where the next one
        or the text's end is. ``data`` is valid UTF-8, ``offsets`` are the texts' bytes in it."""
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(point)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if n == len(data):
            where = np.arange(n + 1)
        else:
            size = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
            where = np.append(0, np.cumsum(size))
        kind = self.kinds[point]
        if (kind == UNKNOWN).any():
            self._ask(np.unique(point[kind == UNKNOWN]))
            kind = self.kinds[point]
        first = np.zeros(n + 1, bool)  # of a text
        first[np.searchsorted(where, offsets)] = True
        blank = kind == BLANK
        # runs of one class inside a text
        begin = first[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        ends = np.append(begin[1:], True)
        cut = begin.copy()
        # the last blank before something: a space joins what follows, another blank stands alone
        led = np.flatnonzero(ends & blank & ~first[1:])
        cut[led] = True
        cut[led[point[led] == 0x20] + 1] = False
        # endings after an apostrophe that starts a piece and is no longer than itself
        mark = np.flatnonzero((point == 0x27) & cut[:n] & ends)
        mark = mark[mark + 1 < n]
        mark = mark[~first[mark + 1]]
        one = mark[np.isin(point[mark + 1], [ord(c) for c in "stmd"])]
        two = mark[mark + 2 < n]
        two = two[~first[two + 2]]
        pair = point[two + 1].astype(np.int64) << 32 | point[two + 2]
        two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
        for at, width in ((one, 2), (two, 3)):
            cut[at + 1] = False
            after = at + width
            # a new piece starts unless the run of letters is over: then its own cut stands
            after = after[after < n]
            cut[after[~begin[after]]] = True
        starts = np.flatnonzero(cut)
        return where[starts], np.searchsorted(where[starts], offsets)
