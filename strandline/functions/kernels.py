"""Per-text computations that have no form in SQL, vectorised over a text.

Texts are arrays of code points.  These run inside ``mapInArrow`` tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)


def window_hashes(codes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each of the sizes, powers of two, the hashes of all windows of that many
    characters; equal windows have equal hashes.  A window is hashed from its halves."""
    out, size = {}, 1
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    while len(h) and size <= max(sizes, default=0):
        if size in sizes:
            mixed = h ^ (h >> np.uint64(29))
            out[size] = (mixed * np.uint64(0xBF58476D1CE4E5B9) ^ (mixed >> np.uint64(32))).view(np.int64)
        h = (h[:-size] * np.uint64(0x94D049BB133111EB) ^ (h[:-size] >> np.uint64(31))) + h[size:] * np.uint64(2 * size + 1)
        size *= 2
    return out


def least_grams(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the grams that are the least, leftmost of equal ones,
    in some window of neighbouring grams."""
    h = window_hashes(codes, [gram]).get(gram, np.zeros(0, np.int64))
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, least = np.zeros(len(h) - window + 1, np.int64), h[: len(h) - window + 1].copy()
    for k in range(1, window):
        other = h[k : k + len(least)]
        lower = other < least
        best[lower], least[lower] = k, other[lower]
    at = np.unique(best + np.arange(len(best)))
    return h[at], at


class Prefixes:
    """Suffixes in order, and common prefixes of any two, in vectorised steps.

    As many characters as fit a number are packed and sorted at once; then the
    prefix compared doubles, and only suffixes that still have an equal are sorted
    again.  Ranks of every round are kept: the common prefix of two suffixes is
    the sum of the lengths at which their ranks agree, from the longest down, and
    what is left is compared character by character.
    """

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.order = np.zeros(0, np.int64)
        if not n:
            return
        dense = _numbers(codes)  # an end is 0
        self.bits = bits = int(dense.max()).bit_length()
        self.width = min(n, 62 // bits)
        key = np.zeros(n, np.int64)
        for i in range(self.width):
            key <<= bits
            key[: n - i] |= dense[i:]
        self.packed = np.append(key, 0)
        order = np.argsort(key)
        head = np.concatenate([[True], np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        step = self.width
        self.levels.append((step, rank.astype(np.int32)))
        while True:
            tied = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(tied):
                break
            s = order[tied]
            ahead = np.where(s + step < n, rank[np.minimum(s + step, n - 1)] + 1, 0)
            key = rank[s] * (n + 1) + ahead
            by = np.argsort(key)
            order[tied], key = s[by], key[by]
            head[tied] = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order[tied]] = np.maximum.accumulate(np.where(head[tied], tied, 0))
            step *= 2
            self.levels.append((step, rank.astype(np.int32)))
        self.order, self.rank = order, rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of different suffixes (n: the empty one)."""
        if not self.n:
            return np.zeros(len(a), np.int64)
        total = np.zeros(len(a), np.int64)
        top = self.n - 1
        for step, rank in reversed(self.levels):  # equal ranks: both are that long
            same = np.where((a <= top) & (b <= top) & (rank[np.minimum(a, top)] == rank[np.minimum(b, top)]), step, 0)
            a, b, total = a + same, b + same, total + same
        # the first character that differs, from the highest bit that does
        differ = self.packed[a] ^ self.packed[b]
        high = differ >> 31
        size = np.where(high > 0, np.frexp(high)[1] + 31, np.frexp(differ & ((1 << 31) - 1))[1])
        return total + (self.width * self.bits - size) // self.bits


def _numbers(codes: np.ndarray) -> np.ndarray:
    """Numbers from 1 on of a text's characters, in their order."""
    most = int(codes.max())
    if codes.min() < 0 or most > 4096 + 16 * len(codes):
        return np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    used = np.zeros(most + 1, bool)
    used[codes] = True
    return np.cumsum(used)[codes]


def common_prefixes(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes.  A few pairs are compared
    character by character, in slices that double; more are told by the order."""
    n = len(codes)
    if len(i) > 64:
        return np.where(i == j, n - i, Prefixes(codes).common(i, j))
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        at, size, most = 0, 64, n - max(a, b)
        while at < most and a != b:
            one, two = codes[a + at : a + min(at + size, most)], codes[b + at : b + min(at + size, most)]
            differ = one != two
            if differ.any():
                most = at + int(differ.argmax())
            at, size = at + size, 2 * size
        out.append(most)
    return np.array(out, np.int64)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and the lengths of the common prefixes of neighbours."""
    p = Prefixes(codes)
    lcp = p.common(p.order[:-1], p.order[1:]) if p.n > 1 else np.zeros(0, np.int64)
    return p.order, np.concatenate([np.zeros(min(1, p.n), np.int64), lcp])


def joint_transform(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other, each with an end: for each suffix in order
    the number of the character before it, 0 for an end; where it starts; and the alphabet,
    numbered from 1 on."""
    joined = np.concatenate([x for t in texts for x in (t, np.full(1, -1, np.int32))])
    order = Prefixes(joined).order
    alphabet = np.unique(joined)[1:]
    return np.searchsorted(alphabet, joined[order - 1]) + (joined[order - 1] >= 0), order, alphabet


#: Characters between two rows of counts in a search.
_COUNTED = 256


def backward_search(last: np.ndarray, alphabet: np.ndarray, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where in a transform the suffixes begin and end that begin with each pattern; equal
    ones if there are none.  All patterns take a step at once."""
    n, kinds = len(last), len(alphabet) + 1
    rows = n // _COUNTED + 1
    counts = np.bincount(np.arange(n) // _COUNTED * kinds + last, minlength=rows * kinds).reshape(rows, kinds)
    first = np.concatenate([[0], np.cumsum(counts.sum(axis=0))[:-1]])
    counts = np.cumsum(counts, axis=0) - counts
    padded = np.concatenate([last, np.zeros(_COUNTED, last.dtype)])

    def before(code: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = at // _COUNTED
        part = padded[(row * _COUNTED)[:, None] + np.arange(_COUNTED)] == code[:, None]
        part &= np.arange(_COUNTED) < (at % _COUNTED)[:, None]
        return first[code] + counts[row, code] + part.sum(axis=1)

    lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
    left = np.array([len(p) for p in patterns], np.int64)
    for some in np.array_split(np.arange(len(patterns)), len(patterns) // 4096 + 1):
        some = some[left[some] > 0]
        while len(some):
            sought = np.array([patterns[k][left[k] - 1] for k in some.tolist()])
            at = np.searchsorted(alphabet, sought)
            known = (at < len(alphabet)) & (alphabet[np.minimum(at, kinds - 2)] == sought)
            hi[some[~known]] = lo[some[~known]]
            some, code = some[known], at[known] + 1
            lo[some], hi[some] = before(code, lo[some]), before(code, hi[some])
            left[some] -= 1
            some = some[(left[some] > 0) & (lo[some] < hi[some])]
    return lo, hi


def lcp_intervals(lcp: np.ndarray, pos: np.ndarray, side: np.ndarray, min_length: int) -> np.ndarray:
    """Intervals of suffixes that share at least ``min_length`` characters, as rows of
    (first position of side 1, of side 2, shortest, longest, suffixes of side 1, of
    side 2); a side without a suffix has position -1.

    One pass with a stack of open intervals: a common prefix shorter than that of
    the open one closes it, and the shortest length is one more than its parent's.
    """
    none = 1 << 40
    ends = np.cumsum(np.concatenate([[0], side == 1]))
    # shorter prefixes end all intervals, and only neighbours of longer ones are in any
    after = np.where(np.append(lcp[1:], 0)[: len(lcp)] >= min_length, np.append(lcp[1:], 0)[: len(lcp)], 0)
    ranks = np.flatnonzero((after > 0) | (np.append(0, after[:-1]) > 0)) if len(lcp) else np.zeros(0, np.int64)
    open_: list[list[int]] = []  # length, first rank, least positions of both sides
    rows: list[tuple[int, ...]] = []
    own = side[ranks] == 1
    firsts, seconds = np.where(own, pos[ranks], none), np.where(own, none, pos[ranks])
    for i, v, one, two in zip(ranks.tolist(), after[ranks].tolist(), firsts.tolist(), seconds.tolist()):
        first = i
        while open_ and open_[-1][0] > v:
            top = open_.pop()
            first, one, two = top[1], min(one, top[2]), min(two, top[3])
            parent = max(v, open_[-1][0] if open_ else 0)
            if top[0] >= min_length:
                rows.append((one, two, max(parent + 1, min_length), top[0], first, i + 1))
        if v and (not open_ or open_[-1][0] < v):
            open_.append([v, first, one, two])
        elif open_:
            top = open_[-1]
            top[2], top[3] = min(one, top[2]), min(two, top[3])
    out = np.array(rows, np.int64).reshape(-1, 6)
    lo, hi = out[:, 4].copy(), out[:, 5].copy()
    out[:, 4] = ends[hi] - ends[lo]
    out[:, 5] = hi - lo - out[:, 4]
    out[:, :2][out[:, :2] == none] = -1
    return out


def unique_substrings(codes: np.ndarray) -> int:
    """Number of distinct substrings."""
    return len(codes) * (len(codes) + 1) // 2 - int(suffix_order(codes)[1].sum())


def longest_repeats(codes: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Length of the longest repeated substrings (0: there is none), and the places of
    each: suffixes that share one are neighbours."""
    order, lcp = suffix_order(codes)
    size = int(lcp.max(initial=0))
    if not size:
        return 0, []
    at = np.flatnonzero(lcp == size)
    apart = np.diff(at) > 1
    first, last = at[np.append(True, apart)] - 1, at[np.append(apart, True)] + 1
    return size, [np.sort(order[a:b]) for a, b in zip(first.tolist(), last.tolist())]


def shortest_unique(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the shortest substrings that occur once, and their places in the order
    of suffixes."""
    order, lcp = suffix_order(codes)
    size = np.maximum(lcp, np.append(lcp[1:], 0)) + 1
    size[order + size > len(codes)] = len(codes) + 1
    least = int(size.min(initial=len(codes) + 1))
    return least, order[size == least]


def invert_bwt(bwt: np.ndarray, original: int) -> np.ndarray:
    """The text (its last character the unique smallest) from its transform.

    The last-to-first map is one stable sort; its orbit is walked by doubling:
    the map's powers of two fill the answer's places bit by bit.
    """
    n = len(bwt)
    if n == 0:
        return bwt
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    at, jump, k = np.full(n, original), step, 0
    place = np.arange(n)  # how many steps back from the end
    while (1 << k) < n:
        odd = (place >> k) & 1 == 1
        at[odd] = jump[at[odd]]
        jump, k = jump[jump], k + 1
    return bwt[at][::-1]


def lz78(codes: np.ndarray) -> int:
    """Number of phrases that were new when read; an unfinished last one is not counted."""
    tree: dict[tuple[int, int], int] = {}
    node = phrases = 0
    for c in codes.tolist():
        nxt = tree.get((node, c))
        if nxt is None:
            phrases += 1
            tree[node, c] = phrases
            node = 0
        else:
            node = nxt
    return phrases


def _next(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the end if none.  Most are near
    and found for all at once; the others, from the right, by way of those that are known."""
    n = len(values)
    out, live = np.full(n, n), np.arange(n)
    for k in range(1, 9):
        live = live[: np.searchsorted(live, n - k)]
        smaller = values[live + k] < values[live]
        out[live[smaller]] = live[smaller] + k
        live = live[~smaller]
    if len(live):
        known, value = out.tolist(), values.tolist()
        for i in live[::-1].tolist():
            j, v = i + 1, value[i]
            while j < n and value[j] > v:
                j = known[j]
            known[i] = j
        out = np.array(known)
    return out


#: Characters by which the candidates of tandem repeats grow together to each side; few grow on.
_GROWN = 16


def _agreeing(codes: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """For how many characters, ``_GROWN`` at most, two places of a text agree, onwards (``way`` 1)
    or backwards (-1)."""
    out, live = np.full(len(a), _GROWN), np.arange(len(a))
    for k in range(_GROWN):
        one, two = a[live] + way * k, b[live] + way * k
        inside = (one >= 0) & (two < len(codes))
        same = inside & (codes[np.maximum(one, 0)] == codes[np.minimum(two, len(codes) - 1)])
        out[live[~same]] = k
        live = live[same]
        if not len(live):
            break
    return out


def tandem_repeats(codes: np.ndarray, max_period: int | None = None) -> list[tuple[int, int, int]]:
    """``(position, unit length, count)``: a stretch of least period d that starts at p
    and is L >= 2 d long, and cannot be extended, repeats a unit L // d times.  For
    each start the longest stays, of equal ones the smallest unit.

    Every such stretch begins its periods somewhere with a Lyndon word in one of
    the alphabet's two orders, which ends at the next smaller (larger) suffix; so
    two candidates a character, extended to both sides, are all of them.
    """
    n = len(codes)
    if n < 2:
        return []
    ahead = Prefixes(codes)
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_next(ahead.rank), _next(-ahead.rank)])
    use = j - i <= min(n // 2, max_period or n)
    i, j = i[use], j[use]
    left, right = _agreeing(codes, i - 1, j - 1, -1), _agreeing(codes, i, j, 1)
    use = (left + right >= j - i) | (left == _GROWN) | (right == _GROWN)
    i, j, left, right = i[use], j[use], left[use], right[use]
    longer = left == _GROWN
    if longer.any():
        left[longer] = common_prefixes(codes[::-1], (n - i)[longer], (n - j)[longer])  # a start at 0 has nothing before it
    longer = right == _GROWN
    right[longer] = ahead.common(i[longer], j[longer])
    start, end, d = i - left, j + right, j - i
    whole = end - start >= 2 * d
    start, d, count = start[whole], d[whole], ((end - start) // np.maximum(d, 1))[whole]
    order = np.lexsort((d, -count * d, start))
    start, d, count = start[order], d[order], count[order]
    first = np.concatenate([[True], start[1:] != start[:-1]]) if len(start) else np.zeros(0, bool)
    return list(zip(start[first].tolist(), d[first].tolist(), count[first].tolist()))


def longest_palindrome(text: str) -> tuple[int, int] | None:
    """Leftmost longest palindrome of at least two characters.

    Radii of all centres grow together, a centre lives while its two next characters
    agree; in most texts few live on.  Where that takes more than ``32`` steps a
    character, radii are found by a binary search over hashes of the text and of its
    reverse, for all centres at once, and the answer is verified."""
    c = code_points(text)
    best = _grown(c, 32 * len(c))
    for base in () if best else (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        at, size = _widest(c, base)
        if np.array_equal(c[at : at + size], c[at : at + size][::-1]):
            best = (at, size)
            break
    if best is None:
        raise ArithmeticError("hashes collided three times")
    return best if best[1] >= 2 else None


def _grown(c: np.ndarray, steps: int) -> tuple[int, int] | None:
    """The palindrome by growing radii; None where that takes more than so many steps."""
    n = len(c)
    best = (0, 0)
    for even in (0, 1):
        left = np.arange(n - even)
        right = left + even
        ok = c[left] == c[right]
        left, right = left[ok], right[ok]
        while len(left):
            steps -= len(left) + 16
            if steps < 0 and n > 1000:
                return None
            size = int(right[0] - left[0] + 1)
            if size > best[1] or (size == best[1] and left[0] < best[0]):
                best = (int(left[0]), size)
            ok = (left > 0) & (right < n - 1)
            left, right = left[ok] - 1, right[ok] + 1
            ok = c[left] == c[right]
            left, right = left[ok], right[ok]
    return best


#: A prime below 2^31: products of two residues fit a 64-bit integer.
_PRIME = (1 << 31) - 1


def _prefix_hashes(c: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes modulo the prime, and powers of the base, by doubling."""
    power = np.ones(1, np.int64)
    step = base % _PRIME
    while len(power) <= len(c):
        power = np.concatenate([power, power * step % _PRIME])
        step = step * step % _PRIME
    power = power[: len(c) + 1]
    h = np.concatenate([[0], (c.astype(np.int64) + 1) % _PRIME])
    reach = 1  # h[i] covers the last `reach` characters before i
    while reach <= len(c):
        more = h.copy()
        more[reach:] = (h[reach:] + h[:-reach] * power[reach]) % _PRIME
        h, reach = more, 2 * reach
    return h, power


#: Bases of the four hashes that together name a stretch.
_BASES = (0x2545F491, 0x1B873593, 0x6C8E9CF5, 0x3C6EF372)


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.int64), base % _PRIME
    while len(out) < n:
        out = np.concatenate([out, out * step % _PRIME])
        step = step * step % _PRIME
    return out[:n]


class Stretches:
    """Names of any stretches of texts, alike for equal ones: two numbers of two hashes each,
    so that 124 bits tell stretches apart."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sides = []
        for base in _BASES:
            sums = np.cumsum((codes.astype(np.int64) + 1) * _powers(base, n) % _PRIME) % _PRIME
            self.sides.append((np.append(0, sums), _powers(pow(base, -1, _PRIME), n + 1)))

    def names(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = [(sums[hi] - sums[lo]) % _PRIME * back[lo] % _PRIME for sums, back in self.sides]
        return a << 31 | b, c << 31 | d


def _widest(c: np.ndarray, base: int) -> tuple[int, int]:
    """Start and length of the leftmost longest stretch that hashes as its reverse does."""
    n = len(c)
    sides = []
    for b in (base, base >> 31 | 1):  # two hashes, so that one collision does not decide
        forward, power = _prefix_hashes(c, b)
        backward, _ = _prefix_hashes(c[::-1], b)
        sides.append((forward, backward, power))

    def same(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.ones(len(lo), bool)
        for forward, backward, power in sides:
            p = power[hi - lo]
            ahead = (forward[hi] - forward[lo] * p) % _PRIME
            back = (backward[n - lo] - backward[n - hi] * p) % _PRIME
            out &= ahead == back
        return out

    best = (0, 0)
    for even in (0, 1):
        centre = np.arange(even, n)
        low, high = np.zeros(len(centre), np.int64), np.minimum(centre, n - centre - 1 + even)
        while (low < high).any():  # the greatest radius at which both directions agree
            mid = (low + high + 1) // 2
            ok = same(centre - mid, centre + mid + 1 - even)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        size = 2 * low + 1 - even
        at = int(size.argmax()) if len(size) else 0
        if len(size) and (size[at] > best[1] or size[at] == best[1] and centre[at] - low[at] < best[0]):
            best = (int(centre[at] - low[at]), int(size[at]))
    return best


def fuzzy(codes: np.ndarray, pattern: np.ndarray, distance: int, deletion: bool = True, insertion: bool = True, wild: int | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of all approximate matches, or of those at the
    given starts (sorted).

    For every start at once: ``d[w]`` is the least number of errors between the
    pattern's first i characters and the w characters from the start on.  A
    match does not begin with an inserted character.  Of equal distances the
    length nearest to the pattern's wins, then the shorter one.
    """
    n, m = len(codes), len(pattern)
    far = distance + 1
    if m == 0:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([codes, np.full(m + distance + 1, -1, codes.dtype)])
    start = np.arange(n + 1) if start is None else start
    # column w of the band: length i + w - distance
    width = 2 * distance + 1
    d = np.full((width, len(start)), far, np.int16)
    d[distance] = 0
    tried = start  # those that may still match
    # row w: the last character of that length; each step of i moves them by one
    here = padded[np.maximum(tried[None, :] + np.arange(-distance - 1, distance)[:, None], 0)]
    for i in range(1, m + 1):
        here = np.concatenate([here[1:], padded[tried + (i + distance - 1)][None, :]])
        any_one = wild is not None and pattern[i - 1] == wild
        new = np.full_like(d, far)
        for w in range(width):
            length = i + w - distance
            if length < 0:
                continue
            if length >= 1:
                step = d[w] if any_one else d[w] + (here[w] != pattern[i - 1])  # from (i - 1, length - 1): the same place in the band
                new[w] = np.where(here[w] == -1, far, step)
            if deletion and w + 1 < width:
                new[w] = np.minimum(new[w], d[w + 1] + 1)  # (i - 1, length)
            if insertion and w >= 1 and length >= 1:
                new[w] = np.minimum(new[w], np.where(here[w] == -1, far, new[w - 1] + 1))  # (i, length - 1)
        d = np.minimum(new, far)
        alive = (d < far).any(axis=0)
        if 4 * np.count_nonzero(alive) < 3 * len(alive):  # errors never become fewer
            tried, d, here = tried[alive], d[:, alive], here[:, alive]
    start = tried
    preference = sorted(range(width), key=lambda w: (abs(w - distance), w))
    best, length = np.full(len(start), far, np.int64), np.zeros(len(start), np.int64)
    for w in preference:
        size = m + w - distance
        if size < 0:
            continue
        better = (d[w] < best) & (start + size <= n)
        best[better], length[better] = d[w][better], size
    hit = np.flatnonzero(best <= distance)
    return start[hit], length[hit], best[hit]


def near_hits(text: str, pieces: list[tuple[int, str]], distance: int) -> np.ndarray:
    """Starts from which one of a pattern's ``distance + 1`` pieces, ``(place in the pattern,
    characters)`` in their order, that occurs in the text would lie in its place, give or
    take as many errors as there are pieces before it: some unchanged piece of each match
    has no more errors before it (the first piece up to whose end they are not more than
    the pieces before it)."""
    near = []
    for before, (place, piece) in enumerate(pieces):
        at = []
        k = text.find(piece)
        while k >= 0:
            at.append(k - place)
            k = text.find(piece, k + 1)
        near.append((np.array(at, np.int64)[:, None] + np.arange(-before, before + 1)[None, :]).ravel())
    spread = np.unique(np.concatenate(near))
    return spread[(spread >= 0) & (spread <= len(text))]


#: Characters of several texts that are compared at once.
_TOGETHER = 1 << 18


def fuzzy_each(texts: list[str], starts: Callable[[str], np.ndarray | None], pattern: np.ndarray, distance: int, deletion: bool = True, insertion: bool = True, wild: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`fuzzy` of many texts, ``(text, start, length, distance)``.  Short texts lie behind
    one another, with more gaps between them than a match is long, and are one call."""
    gap = np.full(len(pattern) + distance + 1, -1, np.int32)
    codes, offsets, tried, rows, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        at = starts(text)
        at = np.arange(len(text) + 1) if at is None else at
        codes += [code_points(text), gap]
        offsets.append(size)
        rows.append(row)
        tried.append(at + size)
        size += len(text) + len(gap)
        if size < _TOGETHER and row + 1 < len(texts):
            continue
        p, n, d = fuzzy(np.concatenate(codes), pattern, distance, deletion, insertion, wild, np.concatenate(tried))
        own = np.searchsorted(offsets, p, "right") - 1
        yield np.array(rows)[own], p - np.array(offsets)[own], n, d
        codes, offsets, tried, rows, size = [], [], [], [], 0
