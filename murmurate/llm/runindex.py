"""A run-length index of strings: the runs of their Burrows-Wheeler transform with suffix-array
samples at run ends, and capped matching statistics of other strings streamed through it."""

from __future__ import annotations

#: The terminator of streamed strings, unlike any symbol of an index (0 ends its strings).
_STOP = 300


def suffix_array(codes):
    """Suffix array of a text of symbols below 512, by prefix doubling from seven symbols in a
    word on; only ties are sorted again."""
    import numpy as np

    n = len(codes)
    key = seven(codes)
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    del key
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1  # the end of the text
    first = np.flatnonzero(new)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))  # a class is named by its first row
    depth = 7
    rows = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)  # rows of classes of several
    del new, first
    while len(rows):
        at = sa[rows]
        key = rank[at].astype(np.int64)
        key *= n + 2
        key += rank[np.minimum(at + np.int32(min(depth, n)), n)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        del order
        sa[rows] = at
        f = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(f, len(rows)))
        rank[at] = np.repeat(rows[f], sizes)
        rows = rows[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return sa


def seven(codes):
    """Seven symbols from each place on, in a word of 63 bits; zeros follow the text."""
    import numpy as np

    n, word = len(codes), np.zeros(len(codes), np.uint64)
    padded = np.append(codes, np.zeros(7, np.uint16))
    for k in range(7):
        word <<= np.uint64(9)
        word |= padded[k : k + n]
    return word


def symbols(body: bytes, sizes, stop: int):
    """Strings as symbols, bytes plus one, each followed by ``stop``; and where the stops are."""
    import numpy as np

    ends = np.cumsum(sizes + 1) - 1
    codes = np.full(int(ends[-1]) + 1 if len(ends) else 0, stop, np.uint16)
    text = np.ones(len(codes), bool)
    text[ends] = False
    codes[text] = np.frombuffer(body, np.uint8).astype(np.uint16) + 1
    return codes, ends


class RunIndex:
    """Runs of the transform of strings, each ended by a terminator.

    ``run_start``: first row; ``run_char``: symbol; ``run_lf``: where the first row leads, the
    others following it; ``run_to``: the run of that row; ``run_first`` and ``run_last``: the
    suffix-array samples of both ends. The suffix array is not kept. ``ends`` are the places of
    the terminators, so that a place tells its string. The text stays, packed, to compare with."""

    def __init__(self, body: bytes, sizes):
        import numpy as np

        codes, self.ends = symbols(body, sizes, 0)
        n = len(codes)
        sa = suffix_array(codes)
        bwt = codes[sa - 1]  # before a string stands the terminator of the one before, or the last
        heads = np.ones(n, bool)
        np.not_equal(bwt[1:], bwt[:-1], out=heads[1:])
        self.run_start = np.flatnonzero(heads)
        self.run_char = bwt[self.run_start].astype(np.int64)
        self.run_end = np.append(self.run_start[1:], n)
        self.run_first, self.run_last = sa[self.run_start], sa[self.run_end - 1]
        del sa, bwt
        # LF: rows with a symbol keep their order; runs of a symbol follow each other. (Not so for
        # terminators, through which no stream goes.)
        self.order = np.argsort(self.run_char, kind="stable")
        size = (self.run_end - self.run_start)[self.order]
        self.run_lf = np.empty(len(size), np.int64)
        self.run_lf[self.order] = np.cumsum(size) - size
        self.run_to = (np.cumsum(heads) - 1)[self.run_lf]
        self.keys = self.run_char[self.order] * len(size) + self.order
        self.words = np.append(seven(codes), np.zeros(64, np.uint64))

    def common(self, words, at, places, cap: int):
        """How many symbols (less than ``cap``, which is 7 k + 1) streamed text from ``at`` on and indexed text from
        ``places`` on have in common."""
        import numpy as np

        out = np.full(len(at), cap - 1, np.int64)
        live = np.arange(len(at))
        for done in range(0, cap - 1, 7):
            x = words[at[live] + done] ^ self.words[places[live] + done]
            differs = x != 0
            stop, x = live[differs], x[differs]
            out[stop] = done
            for k in range(1, 7):
                out[stop] += x < np.uint64(1 << (63 - 9 * k))
            live = live[~differs]
            if not len(live):
                break
        return np.minimum(out, cap - 1)

    def statistics(self, body: bytes, sizes, cap: int):
        """Matching statistics of strings: for every place, flat and without terminators, how many
        symbols from it on the index has (at most ``cap``), and a place in the index that has them.

        All strings are read right to left in step. While a string's next symbol is that of its
        row's run, LF leads on and the place goes back by one. Otherwise the nearest runs of the
        symbol above and below take over, at their near ends, whose samples are the places; the
        one that has more in common with what was read is taken."""
        import numpy as np

        codes, ends = symbols(body, sizes, _STOP)
        words = np.append(seven(codes), np.zeros(64, np.uint64))
        runs = len(self.run_start)
        lengths, places = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32)
        lanes = np.argsort(-sizes, kind="stable")
        count = sizes[lanes]
        at = ends[lanes]
        row, run = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        place, length = np.full(len(lanes), int(self.run_first[0]) if runs else 0, np.int64), np.zeros(len(lanes), np.int64)
        longest = int(count[0]) if len(count) else 0
        live = np.searchsorted(-count, -np.arange(1, longest + 1), "right")  # lanes of at least so many symbols
        for done in range(1, longest + 1):
            m = live[done - 1]
            i, row, run, place, length = at[:m] - done, row[:m], run[:m], place[:m], length[:m]
            c = codes[i].astype(np.int64)
            length = np.minimum(length + 1, cap)
            jump = np.flatnonzero(self.run_char[run] != c)
            lost = jump[:0]
            if len(jump):
                cj = c[jump]
                q = np.searchsorted(self.keys, cj * runs + run[jump])
                best, chosen, near, sample = np.full(len(jump), -1), run[jump], row[jump], place[jump]
                for one, ends_at, samples in ((self.order[q - 1], self.run_end, self.run_last), (self.order[np.minimum(q, runs - 1)], self.run_start, self.run_first)):
                    up = samples is self.run_last
                    there = np.flatnonzero((self.run_char[one] == cj) & ((q > 0) if up else (q < runs)))
                    r = one[there]
                    p = samples[r].astype(np.int64)
                    got = self.common(words, i[jump[there]] + 1, p, cap)
                    better = got > best[there]
                    there, r, p = there[better], r[better], p[better]
                    best[there], chosen[there], near[there], sample[there] = got[better], r, ends_at[r] - up, p
                run[jump], row[jump], place[jump], length[jump] = chosen, near, sample, best + 1
                lost = jump[best < 0]  # the index does not have the symbol: the row stays
            stay = row[lost], run[lost], place[lost]
            row = self.run_lf[run] + (row - self.run_start[run])
            run = self.run_to[run]
            run += self.run_end[run] <= row
            far = np.flatnonzero(self.run_end[run] <= row)
            if len(far):
                run[far] = np.searchsorted(self.run_start, row[far], "right") - 1
            place = place - 1
            if len(lost):
                row[lost], run[lost], place[lost] = stay
            lengths[i], places[i] = length, place
        text = codes != _STOP
        return lengths[text], places[text]


def repeats(body: bytes, start, length, owner, key, window: int, most_rounds: int = 64):
    """For every window of ``window`` bytes of every string, flat and in order of strings,
    whether a string of a smaller owner has it.

    Only strings of one ``key`` can share a window. In rounds, the strings of every group of a
    key are halved by owner; those of the smaller owners are indexed, all groups together, and the
    others streamed through the index: a window is marked where the matching statistics reach
    ``window`` at a place of a smaller owner. Both halves go on, the streamed ones with their
    unmarked windows alone, which no smaller half has; groups of one owner are done. Strings
    whose group has one owner are never looked at, and half of what repeats drops out in every
    round, so all rounds cost about twice the first."""
    import numpy as np

    windows = length - window + 1
    offset = np.cumsum(windows) - windows
    marked = np.zeros(int(windows.sum()), bool)
    # Pieces: windows [first, first + count) of a string; all begin as one.
    string, first, count = np.arange(len(start)), np.zeros(len(start), np.int64), windows.astype(np.int64)
    group = np.unique(key, return_inverse=True)[1].astype(np.int64)
    for _ in range(most_rounds):
        order = np.lexsort((owner[string], group))
        string, first, count, group = string[order], first[order], count[order], group[order]
        own = owner[string]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
        size = np.diff(np.append(head, len(group)))
        several = np.repeat(own[head] != own[head + size - 1], size) if len(head) else np.empty(0, bool)
        string, first, count, group, own = (x[several] for x in (string, first, count, group, own))
        if not len(string):
            return marked
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(head, len(group)))
        # The smaller half ends before a new owner: at the middle one's first, unless it is the first of all.
        pivot = own[head + size // 2]
        low = own[head]
        upper = np.where(np.repeat(pivot > low, size), own >= np.repeat(pivot, size), own > np.repeat(low, size))
        a, b = np.flatnonzero(~upper), np.flatnonzero(upper)
        begin, sizes = start[string] + first, count + window - 1
        index = RunIndex(gather(body, begin[a], sizes[a]), sizes[a])
        lengths, places = index.statistics(gather(body, begin[b], sizes[b]), sizes[b], window)
        # Windows of streamed pieces, flat: the first ``count`` places of each.
        n = count[b]
        lane = np.repeat(np.arange(len(b)), n)
        flat = np.repeat((np.cumsum(sizes[b]) - sizes[b]) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        whole = lengths[flat] >= window
        hit = np.flatnonzero(whole)
        smaller = own[a][np.searchsorted(index.ends, places[flat[hit]])] < own[b][lane[hit]]
        whole[hit[~smaller]] = False
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + first[b][lane]
        marked[offset[string[b][lane]][whole] + inside[whole]] = True
        # What is left of the streamed pieces: runs of unmarked windows.
        left = np.flatnonzero(~whole)
        new = np.concatenate(([True], (left[1:] != left[:-1] + 1) | (lane[left[1:]] != lane[left[:-1]]))) if len(left) else np.empty(0, bool)
        f = np.flatnonzero(new)
        rest = lane[left[f]]
        string = np.concatenate((string[a], string[b][rest]))
        first = np.concatenate((first[a], inside[left[f]]))
        count = np.concatenate((count[a], np.diff(np.append(f, len(left)))))
        group = np.concatenate((group[a] * 2, group[b][rest] * 2 + 1))
        group = np.unique(group, return_inverse=True)[1]
    raise RuntimeError("the halves of owners did not settle")


def gather(body: bytes, start, length) -> bytes:
    """The stretches of ``body``, one after another."""
    import numpy as np

    total = int(length.sum())
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)
    return np.frombuffer(body, np.uint8)[at].tobytes()
