"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 2).

The patterns give the base spans. The random field reads the stretches of words that hold a digit or an ``@``: it
scores whole candidate segments by features that only a whole span has (digits, checksum, grouping, separators, edges),
and a dynamic program over segments of at most LONGEST atoms of their kind chooses boundaries and kinds together. So it parts, for
instance, a phone number from the card number beside it, where a greedy pattern runs over both and drops them. Its
spans are added where they overlap no base span. It is trained at the start on generated stretches, as no table marks
personal data.

Edge cases: a null or empty text has no spans; a very long text or word takes time in proportion; where
segmentations score the same an atom stays outside, or else the longer segment is taken; repeated rows keep their rows; a null id stays null;
other columns are ignored; an empty table gives an empty result. Offsets are code points.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import map_rows, touches, union_of

KINDS = ("email", "ip", "card", "phone")
#: Atoms (runs of digits or of letters, or single other characters) in the longest segment of each kind: an address has 64
#: characters, an @ and 255 more, four bytes have three dots, 19 digits have 18 marks between them, and a phone number's
#: 15 digits each have two marks or a sign before them.
LONGEST = {"email": 320, "ip": 7, "card": 37, "phone": 44}
#: Characters of the longest domain, and digit runs whose segments are scored together.
DOMAIN, RUNS = 255, 8192
#: Generated stretches to learn from, passes over them, learning rate and shrinkage.
EXAMPLES, PASSES, RATE, SHRINK = 400, 6, 0.5, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only spares starts inside a run of digits, which fail wherever the run's own start fails.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the longest run of local characters before it; scanning from every start would be quadratic."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start and then by kind."""
    if not text:
        return []
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
        spans += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _only_digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m.group())) <= 15]
    return in_order(spans)


def _at_most_255(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def in_order(spans: list[tuple[str, int, int]], kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]) if s[0] in kinds else len(kinds), s[2]))


#: Stretches of words on one line that hold a digit or an @, and the atoms in them.
# The look-behind only spares starts inside a word, which would make a long word without a digit quadratic.
_STRETCH = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?:[ \t]{1,2}[^\s0-9@]*[0-9@]\S*)*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^\W0-9A-Za-z]+|\s+|.", re.DOTALL)
_WHOLE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    "ip": re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
    "phone": re.compile(r"\+?[0-9(](?:[ ().-]{0,2}[0-9]){5,14}"),
}
_EDGE = " \t\n,;:.!?\"'()[]<>|"


def segment_features(text: str, begin: int, end: int, kind: str) -> list[str] | None:
    """Names of the features of the segment as this kind; None where it cannot be of the kind."""
    if not _WHOLE[kind].fullmatch(text, begin, end):
        return None
    part = text[begin:end]
    digits = _only_digits(part)
    left = begin == 0 or text[begin - 1] in _EDGE
    right = end == len(text) or text[end] in _EDGE
    made = ["is", f"left{left}", f"right{right}", f"tail{end + 1 < len(text) and text[end] in '.-' and text[end + 1].isdigit()}"]
    groups = re.split(r"[ ().-]+", part.strip("+()"))
    if kind == "email":
        if len(part.rpartition("@")[2]) > DOMAIN:
            return None
        made += [f"ending{part.rpartition('.')[2].isalpha()}", f"dots{'..' in part}"]
    elif kind == "ip":
        made += [f"bytes{all(_at_most_255(g) for g in groups)}", f"zeros{any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    elif kind == "card":
        made += [f"sum{luhn(digits)}", f"digits{len(digits)}", f"first{digits[0] in '3456'}", f"groups{'one' if len(groups) == 1 else 'four' if all(len(g) == 4 for g in groups) else 'odd'}"]
    else:
        made += [f"digits{len(digits)}", f"plus{part[0] == '+'}", f"bracket{'(' in part and ')' in part}", f"groups{min(len(groups), 6)}", f"last{len(groups[-1])}", f"longest{max(map(len, groups))}", f"card{len(digits) >= 13 and luhn(digits)}"]
    return [f"{kind} {m}" for m in made]


def candidates(text: str) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """The bounds of a stretch's atoms, and the segments (from bound, to bound, kind, features) that some kind allows."""
    bounds = [0, *(m.end() for m in _ATOM.finditer(text))]
    kinds = KINDS if "@" in text else KINDS[1:]
    found = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if not (first.isdigit() or first in "+(" or first in _LOCAL):
            continue
        # A kind's longest match from here bounds the ends that need a look.
        limits = [(kind, m.end()) for kind in kinds if (m := _WHOLE[kind].match(text, bounds[i]))]
        far = max((end for _, end in limits), default=0)
        for j in range(i + 1, min(len(bounds), i + 1 + max((LONGEST[kind] for kind, _ in limits), default=0))):
            if bounds[j] > far:
                break
            last = text[bounds[j] - 1]
            for kind, limit in limits:
                if bounds[j] <= limit and j - i <= LONGEST[kind] and (last.isdigit() or (kind == "email" and last in _LOCAL)):
                    made = segment_features(text, bounds[i], bounds[j], kind)
                    if made:
                        found.append((i, j, kind, made))
    return bounds, found


def _outside(text: str, begin: int, end: int) -> str:
    head = text[begin]
    return "out digit" if head.isdigit() else "out at" if head == "@" else "out"


Weights = dict[str, float]
Spans = list[tuple[str, int, int]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _member(codes: np.ndarray, characters: str) -> np.ndarray:
    """Which codes are one of some ASCII characters."""
    table = np.zeros(129, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table[np.minimum(codes, 128)]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class _Line:
    """Arrays over the characters, atoms and digit runs of a text, from which whole segments are scored.

    Each feature of a segment is a difference of running sums or a property of one end, so scores are table look-ups.
    """

    def __init__(self, text: str, weights: Weights):
        self.weights = weights
        codes = self.codes = _codes(text)
        n = len(codes)
        self.bounds = np.fromiter(itertools.chain([0], (m.end() for m in _ATOM.finditer(text))), dtype=np.int64)
        digit = self.digit = (codes >= 48) & (codes <= 57)
        numeral = digit.copy()
        for code in np.unique(codes[codes > 127]):
            if chr(code).isdigit():
                numeral |= codes == code
        edge = _member(codes, _EDGE)
        # Of a span's begin and end: an edge character or the text's own end beside it, and ".5" or "-5" behind it.
        self.left = np.concatenate([[True], edge])
        self.right = np.concatenate([edge, [True]])
        self.tail = np.concatenate([_member(codes[:-1], ".-") & numeral[1:], [False, False]]) if n else np.zeros(1, bool)
        heads = self.bounds[:-1]
        outside = np.where(numeral[heads], self.weight("out digit"), np.where(codes[heads] == ord("@"), self.weight("out at"), self.weight("out")))
        #: The score of leaving all before a position outside, by character position of an atom's bound.
        self.out = np.zeros(n + 1)
        self.out[self.bounds] = _sums(outside)
        steps = np.flatnonzero(np.diff(np.concatenate([[False], digit, [False]]).astype(np.int8)))
        self.begins, self.ends = steps[::2], steps[1::2]

    def weight(self, name: str) -> float:
        return self.weights.get(name, 0.0)

    def table(self, kind: str, name: str, values) -> np.ndarray:
        return np.array([self.weight(f"{kind} {name}{v}") for v in values])

    def ends_of(self, kind: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The part of the score that any kind has, less that of being outside."""
        flag = lambda name, at: self.table(kind, name, (False, True))[at.astype(np.int8)]
        made = self.weight(f"{kind} is") + flag("left", self.left[begin]) + flag("right", self.right[end]) + flag("tail", self.tail[end])
        return made - (self.out[end] - self.out[begin])

    def numbers(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(begins, ends, kind, gain over being outside) of the address, card and phone segments that gain."""
        runs = len(self.begins)
        if not runs:
            return
        codes, size = self.codes, self.ends - self.begins
        value = codes[self.digit].astype(np.int64) - 48
        count = np.concatenate([[0], np.cumsum(size)])  # digits before a run
        twice = np.where(value > 4, 2 * value - 9, 2 * value)
        odd = np.arange(len(value)) % 2 == 1
        sums = np.stack([_sums(np.where(odd, twice, value)), _sums(np.where(odd, value, twice))])
        gap_from, gap_size = self.ends[:-1], self.begins[1:] - self.ends[:-1]
        mark = _sums(_member(codes, " ().-"))
        between = mark[self.begins[1:]] - mark[gap_from] == gap_size
        one = codes[np.minimum(gap_from, len(codes) - 1)]
        # Running counts of gaps that the kind does not allow.
        gaps = {"ip": _sums(~((gap_size == 1) & (one == ord(".")))), "card": _sums(~((gap_size == 1) & ((one == ord(" ")) | (one == ord("-"))))), "phone": _sums(~(between & (gap_size <= 2)))}
        opened, closed = _sums(codes == ord("(")), _sums(codes == ord(")"))
        four = _sums(size != 4)
        short = np.minimum(size, 5)
        number = sum(np.where(short > k, value[np.minimum(count[:-1] + k, len(value) - 1)] * 10 ** np.maximum(short - 1 - k, 0), 0) for k in range(5))
        over, long_run = _sums(number > 255), _sums(size > 4)
        zero = _sums((size > 1) & (value[count[:-1]] == 0))
        first = np.isin(value[count[:-1]], (3, 4, 5, 6))

        def checked(r, s):
            last = count[s + 1] - 1
            side = 1 - last % 2
            # Digits at an odd distance from the last one are doubled.
            return (sums[1 - side, count[s + 1]] - sums[1 - side, count[r]]) % 10 == 0

        starts = list(self._phone_starts())
        for low in range(0, runs, RUNS):
            part = np.arange(low, min(low + RUNS, runs))
            for step in range(19):
                r = part[part + step < runs]
                if not len(r):
                    break
                s = r + step
                digits = count[s + 1] - count[r]
                if step == 3:
                    k = (gaps["ip"][s] == gaps["ip"][r]) & (long_run[s + 1] == long_run[r])
                    yield self._gaining("ip", r[k], s[k], self.begins[r[k]], self.table("ip", "bytes", (False, True))[(over[s + 1] == over[r]).astype(np.int8)[k]] + self.table("ip", "zeros", (False, True))[(zero[s + 1] > zero[r]).astype(np.int8)[k]])
                k = (gaps["card"][s] == gaps["card"][r]) & (digits >= 13) & (digits <= 19)
                if k.any():
                    a, b = r[k], s[k]
                    groups = np.where(a == b, 0, np.where(four[b + 1] == four[a], 1, 2))
                    more = self.table("card", "sum", (False, True))[checked(a, b).astype(np.int8)] + self.table("card", "digits", range(20))[digits[k]] + self.table("card", "first", (False, True))[first[a].astype(np.int8)]
                    yield self._gaining("card", a, b, self.begins[a], more + np.where(groups == 0, self.weight("card groupsone"), np.where(groups == 1, self.weight("card groupsfour"), self.weight("card groupsodd"))))
            for begins, plus, bracket, extra in starts:
                longest = np.zeros(len(part), dtype=np.int64)
                valid = begins[part] >= 0
                for step in range(15):
                    r = part[part + step < runs]
                    valid, longest = valid[: len(r)], longest[: len(r)]
                    s = r + step
                    longest = np.maximum(longest, size[s])
                    digits = count[s + 1] - count[r]
                    valid = valid & (gaps["phone"][s] == gaps["phone"][r]) & (digits <= 15 - bracket)
                    if not valid.any():
                        break
                    k = valid & (digits >= 6 - bracket)
                    if not k.any():
                        continue
                    a, b, n = r[k], s[k], digits[k]
                    start = begins[a]
                    both = (opened[self.ends[b]] > opened[start]) & (closed[self.ends[b]] > closed[start])
                    more = self.table("phone", "digits", range(16))[n] + self.weight(f"phone plus{plus}") + self.table("phone", "bracket", (False, True))[both.astype(np.int8)]
                    more = more + self.table("phone", "groups", range(7))[np.minimum(step + 1 + extra[a], 6)] + self.table("phone", "last", range(16))[size[b]]
                    more = more + self.table("phone", "longest", range(16))[longest[k]] + self.table("phone", "card", (False, True))[((n >= 13) & checked(a, b)).astype(np.int8)]
                    yield self._gaining("phone", a, b, start, more)

    def _phone_starts(self) -> Iterator[tuple[np.ndarray, bool, int, np.ndarray]]:
        """(begin by run or -1, has a plus, starts with a bracket, has a mark left after the brackets) of each way to begin a phone number."""
        codes, begins = self.codes, self.begins
        at = lambda k: np.where(begins >= k, codes[np.maximum(begins - k, 0)], 0)
        plain, mark = _member(codes, " .-"), _member(codes, " ().-")
        is_mark = lambda k: mark[np.maximum(begins - k, 0)]
        is_plain = lambda k: plain[np.maximum(begins - k, 0)]
        none = np.zeros(len(begins), dtype=np.int64)
        yield begins, False, 0, none
        yield np.where(at(1) == ord("+"), begins - 1, -1), True, 0, none
        fits = np.ones(len(begins), dtype=bool)
        for back in (1, 2, 3):
            found = fits & (at(back) == ord("("))
            extra = np.zeros(len(begins), dtype=bool)
            for k in range(1, back):
                extra |= is_plain(k)
            yield np.where(found, begins - back, -1), False, 1, extra.astype(np.int64)
            yield np.where(found & (at(back + 1) == ord("+")), begins - back - 1, -1), True, 1, extra.astype(np.int64)
            fits &= is_mark(back) & (begins >= back)

    def _gaining(self, kind: str, r: np.ndarray, s: np.ndarray, start: np.ndarray, more: np.ndarray):
        end = self.ends[s]
        gain = self.ends_of(kind, start, end) + more
        k = gain > 0
        return start[k], end[k], KINDS.index(kind), gain[k]

    def emails(self) -> Iterator[tuple[list[tuple[int, float]], list[tuple[int, float]]]]:
        """The begins and the ends, with their scores, of each ``@``: an address's score is a part of its begin and one of its end."""
        codes, n = self.codes, len(self.codes)
        ats = np.flatnonzero(codes == ord("@"))
        if not len(ats):
            return
        local = _member(codes, "".join(_LOCAL))
        bound = np.zeros(n + 1, dtype=bool)
        bound[self.bounds] = True
        letter = _member(codes, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        label = letter | self.digit | (codes == ord("-"))
        dot = codes == ord(".")
        flag = lambda name: self.table("email", name, (False, True))
        left, right, tail, ending, dots = map(flag, ("left", "right", "tail", "ending", "dots"))
        # Bytes and lists give single values far faster than arrays do.
        is_label, is_letter, is_dot, is_bound, is_local, lefts, rights, tails = (x.tobytes() for x in (label, letter, dot, bound, local, self.left, self.right, self.tail))
        left, right, tail, ending, dots, out, first = left.tolist(), right.tolist(), tail.tolist(), ending.tolist(), dots.tolist(), self.out, self.weight("email is")
        for at in ats.tolist():
            begins, double, k = [], 0, at - 1
            while k >= max(0, at - 64) and is_local[k]:
                if is_dot[k] and is_dot[k + 1]:
                    double = 1
                if is_bound[k]:
                    begins.append((k, first + left[lefts[k]] + dots[double] + float(out[k])))
                k -= 1
            if not begins:
                continue
            high = min(n, at + 1 + DOMAIN)
            ends, from_label, seen, alpha = [], at + 1, False, True
            for k in range(at + 1, high):
                if is_label[k] and k - from_label < 63:
                    alpha = alpha and is_letter[k] == 1
                    if seen and is_bound[k + 1]:
                        ends.append((k + 1, alpha))
                elif is_dot[k] and k > from_label:
                    from_label, seen, alpha = k + 1, True, True
                else:
                    break
            if not ends:
                continue
            yield begins[::-1], [(e, right[rights[e]] + tail[tails[e]] + ending[alpha] - float(out[e])) for e, alpha in ends]


def best_segments(text: str, weights: Weights) -> Spans:
    """The spans of the best segmentation of a text, by bounded dynamic programming over the segments that gain.

    The value of a position is that of the best segmentation up to it less that of leaving all outside. It never falls,
    so a segment that gains nothing over being outside is never needed, and positions where none ends keep the value.
    """
    line = _Line(text, weights)
    found = [x for x in line.numbers() if len(x[0])]
    begins, ends, kinds, gains = (np.concatenate(x).tolist() for x in zip(*((b, e, np.full(len(b), k), g) for b, e, k, g in found))) if found else ([],) * 4
    arcs = list(zip(ends, begins, kinds, gains))
    # An address is met once for each end; its begin is chosen then, from the values before the @.
    mails = list(line.emails())
    arcs += [(end, m[0][0][0], -1 - k, score) for k, m in enumerate(mails) for end, score in m[1]]
    arcs.sort()
    places, values, back = [0], [0.0], [None]
    chosen: dict[int, tuple[float, int]] = {}
    at = lambda place: bisect.bisect_right(places, place) - 1
    for end, begin, kind, gain in arcs:
        if kind < 0:
            if kind not in chosen:
                chosen[kind] = max((values[at(b)] + s, -b) for b, s in mails[-1 - kind][0])
            value, begin = chosen[kind][0] + gain, -chosen[kind][1]
        else:
            value = values[at(begin)] + gain
        if value > values[-1]:
            step = (KINDS[max(kind, 0)], begin, end)
            if places[-1] == end:
                values[-1], back[-1] = value, step
            else:
                places.append(end)
                values.append(value)
                back.append(step)
    spans, k = [], len(places) - 1
    while back[k] is not None:
        spans.append(back[k])
        k = at(back[k][1])
    return spans[::-1]


def _slopes(text: str, truth: set[tuple[str, int, int]], weights: Weights) -> dict[str, float]:
    """The gradient of the log-likelihood of the true segmentation: its features less the expected ones."""
    bounds, found = candidates(text)
    n = len(bounds)
    arcs = [(k, k + 1, None, [_outside(text, bounds[k], bounds[k + 1])]) for k in range(n - 1)] + found
    scores = [sum(weights.get(m, 0.0) for m in a[3]) for a in arcs]
    order = sorted(range(len(arcs)), key=lambda k: arcs[k][1])
    ahead, behind = np.full(n, -np.inf), np.full(n, -np.inf)
    ahead[0] = behind[n - 1] = 0.0
    for k in order:
        ahead[arcs[k][1]] = np.logaddexp(ahead[arcs[k][1]], ahead[arcs[k][0]] + scores[k])
    for k in sorted(order, key=lambda k: -arcs[k][0]):
        behind[arcs[k][0]] = np.logaddexp(behind[arcs[k][0]], behind[arcs[k][1]] + scores[k])
    inside = {b for _, i, j in truth for b in range(bounds.index(i), bounds.index(j))}
    out: dict[str, float] = {}
    for k, (i, j, kind, made) in enumerate(arcs):
        gold = (kind, bounds[i], bounds[j]) in truth if kind else i not in inside
        change = float(gold) - float(np.exp(ahead[i] + scores[k] + behind[j] - ahead[n - 1]))
        if abs(change) > 1e-6:
            for m in made:
                out[m] = out.get(m, 0.0) + change
    return out


def _generated(count: int) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """Stretches of personal data and of other numbers, one to three side by side, with the true spans."""
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice([14, 14, 14, 14, 13, 12]))
        body += next(c for c in "0123456789" if luhn(body + c))
        mark = rng.choice(["", "", " ", "-"])
        return mark.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        area, local, line = digits(3), digits(3), digits(4)
        plain = [f"({area}) {local}-{line}", f"{area}-{local}-{line}", f"{area}.{local}.{line}", f"{area} {local} {line}"]
        return rng.choice(["+1 ", "+1 ", f"+{rng.randint(20, 99)} ", f"+{rng.randint(20, 99)} ", ""]) + rng.choice(plain[:1] * 2 + plain)

    def number() -> str:
        return rng.choice([digits(rng.randint(1, 6)), f"{digits(1)}.{digits(1)}", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 23)}:{digits(2)}",
                           f"{digits(2)}.{digits(2)}", digits(rng.randint(20, 30)), f"v{digits(1)}.{digits(2)}.{digits(1)}", letters(3) + digits(2), f"{digits(3)}.{digits(3)}.{digits(3)}.{rng.randint(300, 999)}", f"{digits(4)} {digits(4)}"])

    makers = {
        "email": lambda: f"{letters(rng.randint(2, 8))}{rng.choice(['', '.', '_'])}{digits(rng.choice([0, 2]))}@{letters(5)}{digits(rng.choice([0, 1]))}.{letters(rng.randint(2, 6))}{rng.choice(['', '.com', '.org'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone, None: number,
    }
    for _ in range(count):
        text, truth = "", set()
        for k in range(rng.choice([1, 1, 2, 2, 3])):
            text += " " * (k > 0) + rng.choice(["", "", "", "no.", "x"]) * (k == 0)
            kind = rng.choice([*KINDS, None, None])
            part = makers[kind]()
            if kind and (not text or not text[-1].isalpha()):
                truth.add((kind, len(text), len(text) + len(part)))
            elif kind:
                text += " "
                truth.add((kind, len(text), len(text) + len(part)))
            text += part
        yield text + rng.choice(["", "", ",", "."]), truth


@functools.lru_cache(maxsize=1)
def train(examples: int = EXAMPLES) -> Weights:
    """Maximise the likelihood of the true segmentations by gradient steps scaled by past slopes."""
    weights: Weights = {}
    past: dict[str, float] = {}
    made = list(_generated(examples))
    for _ in range(PASSES):
        for text, truth in made:
            for name, slope in _slopes(text, truth, weights).items():
                slope -= SHRINK * weights.get(name, 0.0)
                past[name] = past.get(name, 0.0) + slope * slope
                weights[name] = weights.get(name, 0.0) + RATE * slope / (past[name] ** 0.5 + 1e-6)
    return weights


def spans_of(texts: list[str | None], weights: Weights) -> Iterator[tuple[Spans, Spans]]:
    """(base spans, base and added spans) of each text; all stretches of the texts are segmented in one programme.

    A line end stands between two stretches. No segment holds one, and it is an edge like a text's own ends.
    """
    where, parts, places, upto = [], [], [], 0
    for k, text in enumerate(texts):
        if text and ("@" in text or _DIGITS.search(text)):
            for stretch in _STRETCH.finditer(text):
                parts.append(stretch.group())
                places.append(upto)
                where.append((k, stretch.start() - upto))
                upto += len(parts[-1]) + 1
    found: dict[int, Spans] = {}
    for kind, begin, end in best_segments("\n".join(parts), weights) if parts else ():
        k, shift = where[bisect.bisect_right(places, begin) - 1]
        found.setdefault(k, []).append((kind, begin + shift, end + shift))
    for k, text in enumerate(texts):
        base = base_spans(text)
        covered = union_of(base)
        added = [s for s in found.get(k, ()) if not touches(covered, s[1], s[2])]
        yield base, in_order(base + added) if added else base


def all_spans(text: str | None, weights: Weights) -> tuple[Spans, Spans]:
    """(base spans, base and added spans)."""
    return next(spans_of([text], weights))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, begin, end) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def rows(columns: list[list]) -> Iterator[tuple]:
        for doc_id, (base, spans) in zip(columns[0], spans_of(columns[1], shared.value)):
            yield doc_id, *([{"kind": k, "begin": b, "end": e} for k, b, e in s] for s in (base, spans))

    span = "array<struct<kind: string, begin: int, end: int>>"
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, f"doc_id long, base {span}, spans {span}")


def digest(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
