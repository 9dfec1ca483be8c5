"""Byte-level BPE compiled to finite-state transducers that count and name tokens.

Two machines run one after the other over the UTF-8 bytes of a batch of texts.

*Splitter.* A twelve-state machine over character classes cuts text into pretokens. Texts are laid end to end with a
separator, cut into chunks of equal length, and every chunk is run from every state at once: that gives the chunk's
state map. The maps are composed by a parallel prefix scan (function composition is associative), which yields the
state each chunk really starts in; a second pass from those states emits the cuts.

*Merger.* Inside a pretoken the canonical tokenization of a prefix has one last token, and it is decided by the
tokens that end at the start of each vocabulary entry which is still being read. A state is that tuple, so reading a
byte is a deterministic transition, annotated with the change in the number of tokens of the prefix. Transitions are
compiled when first met and kept per worker process. When ``max_states`` is reached, states that no later batch came
back to are dropped, which bounds memory.
All pretokens of a batch advance in step, one numpy gather per byte position.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np

SEPARATOR = 0xFF  # never occurs in UTF-8

# Character classes of the splitter.
C_LETTER, C_STMD, C_RV, C_LL, C_E, C_NUM, C_OTHER, C_QUOTE, C_SPACE, C_WS, C_END = range(11)
# States of the splitter; a name tells what has been read since the last cut.
S_FRESH, S_WORD, S_NUM, S_OTHER, S_QUOTE, S_QUOTE_RV1, S_QUOTE_L, S_SP1, S_WS1, S_SPN, S_WSN = range(11)
N_CLASSES, N_STATES = 11, 11
CUT_HERE, CUT_BEFORE = 1, 2
LETTERS = (C_LETTER, C_STMD, C_RV, C_LL, C_E)


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and cuts[state, class] of the splitter, derived from the pattern's alternatives."""
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    cut = np.zeros((N_STATES, N_CLASSES), np.uint8)
    opening = {C_NUM: S_NUM, C_OTHER: S_OTHER, C_QUOTE: S_QUOTE, C_SPACE: S_SP1, C_WS: S_WS1, C_END: S_FRESH}
    opening |= dict.fromkeys(LETTERS, S_WORD)
    for state in range(N_STATES):
        for cls in range(N_CLASSES):
            to, out = opening[cls], CUT_HERE if cls != C_END else 0
            blank = cls in (C_SPACE, C_WS)
            if state == S_WORD and cls in LETTERS:
                to, out = S_WORD, 0
            elif state == S_NUM and cls == C_NUM:
                to, out = S_NUM, 0
            elif state in (S_OTHER, S_QUOTE) and cls in (C_OTHER, C_QUOTE):
                to, out = S_OTHER, 0
            elif state == S_QUOTE and cls == C_STMD:
                to, out = S_FRESH, 0
            elif state == S_QUOTE and cls == C_RV:
                to, out = S_QUOTE_RV1, 0
            elif state == S_QUOTE and cls == C_LL:
                to, out = S_QUOTE_L, 0
            elif state == S_QUOTE_RV1 and cls == C_E or state == S_QUOTE_L and cls == C_LL:
                to, out = S_FRESH, 0
            elif state in (S_QUOTE_RV1, S_QUOTE_L):
                # the letter after the quote starts a word of its own after all
                out |= CUT_BEFORE
                if cls in LETTERS:
                    to, out = S_WORD, CUT_BEFORE
            elif state in (S_SP1, S_WS1, S_SPN, S_WSN) and blank:
                to, out = S_SPN if cls == C_SPACE else S_WSN, 0
            elif state in (S_SP1, S_SPN) and cls != C_END:
                # the last space joins what follows, the blanks before it stay behind
                to = S_OTHER if cls == C_QUOTE else opening[cls]
                out = CUT_BEFORE if state == S_SPN else 0
            elif state == S_WSN and cls != C_END:
                out = CUT_BEFORE | CUT_HERE
            nxt[state, cls], cut[state, cls] = to, out
    return nxt, cut


def class_table() -> np.ndarray:
    """Character class of every code point."""
    kinds = {"L": C_LETTER, "N": C_NUM}
    table = np.full(0x110000, C_OTHER, np.uint8)
    for cp in range(0x110000):
        k = kinds.get(unicodedata.category(chr(cp))[0])
        if k is not None:
            table[cp] = k
    for cp in [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = C_WS
    table[0x20] = C_SPACE
    for chars, k in (("stmd", C_STMD), ("rv", C_RV), ("l", C_LL), ("e", C_E), ("'", C_QUOTE)):
        for ch in chars:
            table[ord(ch)] = k
    return table


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points at the lead bytes of UTF-8 ``data``; separators become 0x10FFFF + 1."""
    b0 = data[lead].astype(np.int32)
    cp = b0.copy()
    wide = np.flatnonzero(b0 >= 0xC0)
    if wide.size:
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        p, w = lead[wide], b0[wide]
        b1, b2, b3 = (padded[p + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        two = (w & 0x1F) << 6 | b1
        three = (w & 0x0F) << 12 | b1 << 6 | b2
        four = (w & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        cp[wide] = np.where(w < 0xE0, two, np.where(w < 0xF0, three, np.where(w < 0xF8, four, 0x110000)))
    return cp


class Splitter:
    """Cuts texts into pretokens by chunk state maps and a prefix scan."""

    def __init__(self, chunk: int = 1024):
        self.chunk = chunk
        self.next, self.cut = splitter_tables()
        self.classes = np.append(class_table(), np.uint8(C_END))
        self.ascii = self.classes[:256].copy()
        self.ascii[SEPARATOR] = C_END

    def entry_states(self, blocks: np.ndarray) -> np.ndarray:
        """State at the start of each chunk; ``blocks`` holds one chunk of classes per row."""
        flat = np.ascontiguousarray(self.next.T).ravel()  # [class, state]
        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (len(blocks), 1))
        offsets = np.ascontiguousarray(blocks.T) * np.uint8(N_STATES)
        head = min(32, len(offsets))
        for row in offsets[:head]:
            maps = flat[maps + row[:, None]]
        # after a blank and a letter all states have met, and one run stands for all
        met = (maps == maps[:, :1]).all(axis=1)
        if met.any():
            one = maps[met, 0]
            for row in np.ascontiguousarray(offsets[head:, met]):
                one = flat[one + row]
            maps[met] = one[:, None]
        if not met.all():
            apart = maps[~met]
            for row in np.ascontiguousarray(offsets[head:, ~met]):
                apart = flat[apart + row[:, None]]
            maps[~met] = apart
        step = 1
        while step < len(maps):  # Hillis-Steele scan: after it, maps[i] maps the first state to the end of chunk i
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
            step *= 2
        return np.concatenate([[np.uint8(S_FRESH)], maps[:-1, S_FRESH]])

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where pretokens start, and where they end, in texts that each end with SEPARATOR."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cls = self.ascii[data[lead]]
        wide = np.flatnonzero((data[lead] >= 0x80) & (data[lead] != SEPARATOR))
        if wide.size:
            cls[wide] = self.classes[code_points(data, lead[wide])]
        n, c = len(cls), self.chunk
        rows = -(-n // c)
        blocks = np.full(rows * c, C_END, np.uint8)
        blocks[:n] = cls
        blocks = blocks.reshape(rows, c)
        state = self.entry_states(blocks)
        flat_next, flat_cut = np.ascontiguousarray(self.next.T).ravel(), np.ascontiguousarray(self.cut.T).ravel()
        out = np.empty((c, rows), np.uint8)
        offsets = np.ascontiguousarray(blocks.T) * np.uint8(N_STATES)
        for k, row in enumerate(offsets):
            at = state + row
            out[k] = flat_cut[at]
            state = flat_next[at]
        out = out.T.ravel()[:n]
        here = (out & CUT_HERE) > 0
        back = np.flatnonzero(out & CUT_BEFORE)
        here[back - 1] = True
        starts = lead[here]
        # a pretoken ends where the next one starts, or at the separator that comes first
        seps = lead[cls == C_END]
        ends = np.append(starts[1:], len(data))
        first_sep = seps[np.minimum(np.searchsorted(seps, starts), len(seps) - 1)]
        return starts, np.minimum(ends, np.where(first_sep >= starts, first_sep, len(data)))


class Merger:
    """Lazily compiled transducer from the bytes of a pretoken to tokens of a byte-level BPE vocabulary."""

    START = -1
    FEW = 8

    def __init__(self, merges: list[tuple[int, int, int]], byte_ids: dict[int, int], token_bytes: dict[int, bytes], max_states: int = 100_000):
        """merges: (left id, right id, merged id) by rank."""
        self.max_states = max_states
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(merges)}
        self.born = dict.fromkeys(byte_ids.values(), -1) | {m: r for r, (_, _, m) in enumerate(merges)}
        parts = {m: (a, b) for a, b, m in merges}
        self.parts = parts
        self.known: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        canonical = set(byte_ids.values())
        for a, b, m in merges:
            if a in canonical and b in canonical and not self._crosses(a, b, self.born[m]):
                canonical.add(m)
        for t in canonical:
            node = 0
            for byte in token_bytes[t]:
                key = node << 8 | byte
                to = self.child.get(key)
                if to is None:
                    to = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = to
            self.token_at[node] = t
        self.length = np.zeros(max(token_bytes) + 1, np.int32)
        for t, b in token_bytes.items():
            self.length[t] = len(b)
        self.reset()

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(symbol, rank that made it, rank that ends it) down one edge of the token's merge tree."""
        out, until = [], 1 << 30
        while True:
            out.append((token, self.born[token], until))
            if token not in self.parts:
                return out
            until = self.born[token]
            token = self.parts[token][side]

    def _crosses(self, a: int, b: int, before: int = 1 << 30) -> bool:
        """Whether some merge below rank ``before`` joins the end of ``a`` to the start of ``b``."""
        get = self.rank.get
        left = self._edge(b, 0)
        for x, x_from, x_to in self._edge(a, 1):
            for y, y_from, y_to in left:
                r = get(x << 32 | y)
                # of equal pairs the leftmost merges first, hence < on one side and <= on the other
                if r is not None and r < before and x_from < r < x_to and y_from < r <= y_to:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` in a canonical tokenization."""
        key = a << 32 | b
        ok = self.known.get(key)
        if ok is None:
            ok = self.known[key] = not self._crosses(a, b)
        return ok

    def reset(self) -> None:
        """Forget the compiled transitions."""
        # a state is packed into bytes: for each vocabulary entry being read its node, the token it follows, and how
        # many tokens that prefix has more than the whole one
        first = array("i", (0, self.START, 0)).tobytes()
        self.ids = {first: 0}
        self.states = [first]
        if len(self.known) > 2 * self.max_states:
            self.known.clear()
        size = 1 << 12
        self.last = np.zeros(size, np.int32)
        self.made, self.seen = np.zeros(size, np.int32), np.zeros(size, np.int32)  # batch that made a state, that met it last
        self.page = np.zeros(size * 8, np.int32)  # [state, byte // 32] -> page
        self.to = np.full((size, 32), -1, np.int32)  # page -> next state
        self.delta = np.zeros((size, 32), np.int8)  # emitted tokens of the transition
        self.n_pages, self.batch = 1, 0

    def shrink(self) -> None:
        """Keeps the states that a later batch came back to, at most half of ``max_states``, the latest ones."""
        n = len(self.states)
        seen = np.where(self.seen[:n] > self.made[:n], self.seen[:n], -1)
        seen[0] = self.batch + 1
        kept = np.sort(np.argsort(-seen, kind="stable")[: self.max_states // 2])
        kept = kept[seen[kept] >= 0]
        number = np.full(n + 1, -1, np.int32)
        number[kept] = np.arange(len(kept))
        old = [self.states[k] for k in kept.tolist()]
        pages = self.page.reshape(-1, 8)[kept]
        used = np.flatnonzero(pages)
        to, delta = self.to[pages.ravel()[used]], self.delta[pages.ravel()[used]]
        last, batch, seen = self.last[kept], self.batch, self.seen[kept]
        self.reset()
        self.batch, self.states, self.ids = batch, old, {s: k for k, s in enumerate(old)}
        size = 1 << max(12, int(len(kept) * 1.25).bit_length())
        self.last, self.seen, self.made = (np.resize(np.append(x, np.zeros(size - len(kept), np.int32)), size).astype(np.int32) for x in (last, seen, np.full(len(kept), -1)))
        self.page = np.zeros(size * 8, np.int32)
        self.page[used] = np.arange(1, len(used) + 1)
        self.n_pages = len(used) + 1
        room = self.n_pages + self.n_pages // 4 + 1
        self.to, self.delta = np.full((room, 32), -1, np.int32), np.zeros((room, 32), np.int8)
        self.to[1 : self.n_pages] = number[to]
        self.delta[1 : self.n_pages] = delta

    def _compile(self, state: int, byte: int) -> None:
        packed = array("i", self.states[state])
        kept, last, tally = [], None, 0
        for k in range(0, len(packed), 3):
            prev, n = packed[k + 1], packed[k + 2]
            to = self.child.get(packed[k] << 8 | byte)
            if to is None:
                continue
            t = self.token_at[to]
            if last is None and t >= 0 and (prev < 0 or self.fits(prev, t)):
                last, tally = t, n + 1
            if self.inner[to]:
                kept.append((to, prev, n))
        # counts are relative to the newest prefix
        flat = array("i")
        for to, prev, n in kept:
            flat.extend((to, prev, n - tally))
        flat.extend((0, last, 0))
        key = flat.tobytes()
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.last):
                more = np.zeros(len(self.last) // 2, np.int32)
                self.last, self.made, self.seen = (np.append(x, more) for x in (self.last, self.made, self.seen))
                self.page = np.append(self.page, np.zeros(8 * len(more), np.int32))
            self.last[to] = last
            self.made[to] = self.batch
        slot = state * 8 + (byte >> 5)
        page = self.page[slot]
        if page == 0:
            page = self.page[slot] = self.n_pages
            self.n_pages += 1
            if page >= len(self.to):
                more = len(self.to) // 2
                self.to = np.concatenate([self.to, np.full((more, 32), -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros((more, 32), np.int8)])
        self.to[page, byte & 31] = to
        self.delta[page, byte & 31] = tally

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Index of each transition in the page arrays, compiled where it is new."""
        high, low = byte >> 5, byte & 31
        page = self.page[state * 8 + high]
        at = page.astype(np.int64) * 32 + low
        # page 0 stays empty, so a missing page reads as a missing transition
        new = np.flatnonzero(self.to.ravel()[at] < 0)
        if new.size:
            for key in np.unique(state[new].astype(np.int64) << 8 | byte[new]):
                self._compile(int(key >> 8), int(key & 255))
            at[new] = self.page[state[new] * 8 + high[new]].astype(np.int64) * 32 + low[new]
        return at

    def _alone(self, data: np.ndarray, low: int, high: int, state: int, last: np.ndarray | None) -> tuple[int, int]:
        """End state and tokens of one run of bytes from ``state``."""
        total, step = 0, 1 << 14
        for begin in range(low, high, step):
            for pos, byte in enumerate(data[begin : min(high, begin + step)].tolist(), begin):
                page = self.page.item(state * 8 + (byte >> 5))
                to = self.to.item(page, byte & 31) if page else -1
                if to < 0:
                    self._compile(state, byte)
                    page = self.page.item(state * 8 + (byte >> 5))
                    to = self.to.item(page, byte & 31)
                total += self.delta.item(page, byte & 31)
                state = to
                self.seen[state] = self.batch
                if last is not None:
                    last[pos] = self.last[state]
        return state, total

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, trace: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens in each pretoken, and with ``trace`` the last token after every byte of ``data``."""
        if len(self.states) > self.max_states:
            self.shrink()
        self.batch += 1
        size = (ends - starts).astype(np.int32)
        # 16-bit keys are radix-sorted
        order = np.argsort((0xFFFF - size).astype(np.uint16) if size.max(initial=0) <= 0xFFFF else -size, kind="stable")
        first, longest = starts[order], size[order]
        left = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(longest) else 0) + 1), side="right")
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int32)
        last = np.zeros(len(data), np.int32) if trace else None
        for k, n in enumerate(left):
            if n <= self.FEW:
                # the longest runs go on alone, without an array for each byte
                for i in range(n):
                    state[i], more = self._alone(data, int(first[i]) + k, int(first[i] + longest[i]), int(state[i]), last)
                    total[i] += more
                break
            pos = first[:n] + k
            at = self._step(state[:n], data[pos].astype(np.int64))
            state[:n] = self.to.ravel()[at]
            self.seen[state[:n]] = self.batch
            total[:n] += self.delta.ravel()[at]
            if trace:
                last[pos] = self.last[state[:n]]
        out = np.empty(len(order), np.int32)
        out[order] = total
        return out, last


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """A vocabulary file's splitter, merger and special strings."""

    def __init__(self, spec: str, max_states: int = 100_000):
        """spec: the text of a tokenizer file with byte-level BPE, no normalizer and the usual word pattern."""
        doc = json.loads(spec)
        model, pre = doc["model"], doc["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or doc.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer, prefix space or whole-word shortcut is compiled")
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        raw = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.splitter = Splitter()
        self.merger = Merger(merges, {b: vocab[c] for c, b in alphabet.items()}, raw, max_states)
        self.special = [(t["content"].encode(), t["id"]) for t in doc.get("added_tokens", [])]

    def _lay_out(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts with a separator after each and in place of special strings; text starts; special starts and ids."""
        n = len(offsets) - 1
        view, bounds = memoryview(data), offsets.tolist()
        laid = bytearray(bytes([SEPARATOR]).join([*(view[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), b""]))
        laid = np.frombuffer(laid, np.uint8)
        begins = offsets[:-1] + np.arange(n)
        found: list[tuple[int, int]] = []
        for needle, token in self.special:
            whole, at = laid.tobytes(), -1
            while (at := whole.find(needle, at + 1)) >= 0:
                found.append((at, token))
                laid[at : at + len(needle)] = SEPARATOR
        found.sort()
        return laid, begins, np.array([p for p, _ in found], np.int64), np.array([t for _, t in found], np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text; text i is data[offsets[i]:offsets[i + 1]]."""
        if len(offsets) < 2:
            return np.zeros(0, np.int64)
        laid, begins, special, _ = self._lay_out(data, offsets)
        starts, ends = self.splitter.cuts(laid)
        tokens, _ = self.merger.run(laid, starts, ends)
        sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
        edge = np.append(begins, len(laid))
        spans = np.searchsorted(starts, edge)
        return np.diff(sums[spans]) + np.diff(np.searchsorted(special, edge))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and the bounds of each text in them."""
        if len(offsets) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        laid, begins, special, special_ids = self._lay_out(data, offsets)
        starts, ends = self.splitter.cuts(laid)
        _, last = self.merger.run(laid, starts, ends, trace=True)
        # walk back from each pretoken's end; a token starts where the one before it ends
        marks = np.full(len(laid), -1, np.int32)
        pos, low = ends.astype(np.int64), starts
        while len(pos):
            token = last[pos - 1]
            pos = pos - self.merger.length[token]
            marks[pos] = token
            more = pos > low
            pos, low = pos[more], low[more]
        marks[special] = special_ids
        where = np.flatnonzero(marks >= 0)
        return marks[where].astype(np.uint32), np.searchsorted(where, np.append(begins, len(laid)))
