"""Secret scans by fixed patterns and a linear-chain conditional random field (operator 4).

The patterns give the base spans. The random field tags tokens as begin, inside or outside of a secret, from the shape
of the token and its neighbours, the words and marks before it, and features of the whole file, and is decoded by
Viterbi. Candidates are tokens anywhere that mix letters with digits (six characters) or cases (eight), and, near an
announcing word or with a known prefix, any token or run of joined tokens of six or more characters. Another word can't be part of a secret by itself and parts the chain, so
stretches of words around the candidates, with the tokens that their features look at, give the same tags as decoding
the whole text. Its spans are added, as kind ``secret``, where they overlap no base span. It is trained at the start on
generated lines, as no table marks secrets.

Edge cases: a null or empty text has no spans; a very long text or word takes time in proportion; of taggings that score
the same the one with the earlier tag (outside, begin, inside) at its last difference is taken; repeated rows keep their
rows; a null id stays null; other columns are ignored by the scan and kept by the redaction; an empty table gives an
empty result. Offsets are code points.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import by_text, map_rows, touches, union_of

KINDS = ("assign", "access", "hex")
ADDED, REDACTED = "secret", "[SECRET]"
OUT, BEGIN, INSIDE = 0, 1, 2
#: Tokens before a candidate that its features look at.
BEFORE = 3
#: Generated lines to learn from, passes over them, learning rate and shrinkage.
EXAMPLES, PASSES, RATE, SHRINK = 500, 5, 0.4, 1e-4

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9_+/.~-]+|[^\sA-Za-z0-9_+/.~-]")
#: Tokens that may be part of a secret unannounced: of SHORT or more characters with a letter and a digit, or of eight or
#: more with a capital inside; the features say which are. Words in one case and plain numbers tell nothing by themselves.
_CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9_+/.~-])(?:(?=[A-Za-z_+/.~-]*[0-9])(?=[0-9_+/.~-]*[A-Za-z])[A-Za-z0-9_+/.~-]{6,}|(?=[A-Za-z0-9_+/.~-]*[a-z][A-Z])[A-Za-z0-9_+/.~-]{8,})"
)
#: Candidates with enough characters for features of their distribution; others have features of their letters.
_LONG = re.compile(r"(?=[A-Za-z_+/.~-]*[0-9])(?=[0-9_+/.~-]*[A-Za-z])[A-Za-z0-9_+/.~-]{12,}")
#: Words that announce a secret, and prefixes of well-known kinds of keys: fixed values, in lower case.
WORDS = ("password", "passwd", "pwd", "pass", "secret", "token", "key", "apikey", "auth", "bearer", "credential", "private")
PREFIXES = ("sk_", "pk_", "ghp_", "gho_", "glpat-", "xox", "eyj", "aiza", "akia", "asia")
#: Announced tokens, or runs of joined ones, may be secrets from so many characters on, so many tokens after the word.
SHORT, NEAR = 6, 3
_ANNOUNCES = re.compile("pass|pwd|secret|token|key|auth|bearer|credential|private", re.IGNORECASE | re.ASCII)
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9_+/.~-])(?:{'|'.join(PREFIXES)})[A-Za-z0-9_+/.~-]*", re.IGNORECASE | re.ASCII)
_SPACE = re.compile(r"\s")
#: A token that can't be inside a secret unless it is a candidate.
_PARTS_CHAIN = re.compile(r"[A-Za-z0-9_+/.~-]{2,}")
#: Marks that stand around a value rather than in it.
_AROUND_VALUE = frozenset("=:\"'`()[]{}<>,;")
#: Pairs of letters that are common in words.
_PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr "
    "ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke fr oo av ag if ap gr od bo sp rd do uc bu ei".split()
)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start and then by kind."""
    if not text:
        return []
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return in_order(spans + [("hex", *m.span()) for m in _HEX.finditer(text)])


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[2]))


def is_candidate(token: str) -> bool:
    return bool(_CANDIDATE.fullmatch(token))


def is_long(token: str) -> bool:
    return bool(_LONG.fullmatch(token))


def _shape(token: str) -> str:
    if not token[0].isalnum() and len(token) == 1:
        return token
    kinds = [name for name, pattern in (("a", "[a-z]"), ("A", "[A-Z]"), ("9", "[0-9]"), ("+", "[+/_~-]"), (".", r"\.")) if re.search(pattern, token)]
    return "".join(kinds)


def _entropy(token: str) -> float:
    counts = Counter(token)
    return -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())


def file_features(text: str) -> list[str]:
    """Features of the whole text that every token shares."""
    lines = text.count("\n") + 1
    marks = text.count("=") + text.count(":") + text.count(";") + text.count("{")
    return [f"file marks{min(4, int(8 * marks / (lines + len(text) / 80)))}", f"file long{len(text) > 2000}"]


def _announced(tokens: list[re.Match]) -> list[bool]:
    """Which tokens may be secrets as an announcing word or a prefix says so: of SHORT characters, or in a run that is."""
    names = [m.group() for m in tokens]
    out = [len(t) >= SHORT and t.lower().startswith(PREFIXES) for t in names]
    last = -NEAR - 1
    k = 0
    while k < len(names):
        end = k + 1
        if k - last <= NEAR and names[k] not in _AROUND_VALUE:
            # The run of joined tokens to the next space or mark around it.
            while end < len(names) and tokens[end].start() == tokens[end - 1].end() and names[end] not in _AROUND_VALUE:
                end += 1
            if tokens[end - 1].end() - tokens[k].start() >= SHORT:
                out[k:end] = [True] * (end - k)
        for j in range(k, end):
            if _ANNOUNCES.search(names[j]):
                last = j
        k = end
    return out


def _odd_pairs(token: str) -> int:
    """How many of ten pairs of neighbouring letters are uncommon in words."""
    letters = [a + b for a, b in zip(token.lower(), token.lower()[1:]) if a.isalpha() and b.isalpha()]
    return int(10 * sum(p not in _PAIRS for p in letters) / len(letters)) if letters else 0


def token_features(tokens: list[str], at: int, shared: list[str], announced: bool = False, joined: bool = False) -> list[str]:
    """Names of the features of one token, which may be announced and joined to the one before it."""
    token = tokens[at]
    if announced and not is_long(token):
        return _announced_features(tokens, at, joined)
    if not announced and not is_long(token) and is_candidate(token):
        return _short_features(tokens, at)
    if not is_candidate(token):
        return ["plain", f"plain {token}" if len(token) == 1 else "plain word"]
    lower = token.lower()
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])) / len(token)
    made = [
        "candidate", f"shape {_shape(token)}", f"length {min(len(token) // 6, 8)}", f"entropy {int(2 * _entropy(token))}", f"turns {int(turns * 8)}",
        f"hex {re.fullmatch('[0-9a-fA-F]+', token) is not None}", f"digits {int(5 * sum(c.isdigit() for c in token) / len(token))}",
        f"dots {min(token.count('.'), 4)}", f"slashes {min(token.count('/'), 3)}", f"prefix {next((p for p in PREFIXES if lower.startswith(p)), '')}",
        f"vowels {int(5 * sum(c in 'aeiou' for c in lower) / len(token))}", f"upper {int(4 * sum(c.isupper() for c in token) / len(token))}",
    ]
    for step in range(1, BEFORE + 1):
        near = tokens[at - step].lower() if at >= step else "^"
        made.append(f"before{step} {near}" if len(near) == 1 else f"before{step} word")
        if any(w in near for w in WORDS):
            made += [f"announced{step}", "announced"]
    after = tokens[at + 1] if at + 1 < len(tokens) else "$"
    made.append(f"after {after}" if len(after) == 1 else "after word")
    return made + shared


def _announced_features(tokens: list[str], at: int, joined: bool) -> list[str]:
    """The features of an announced token that would be no candidate by itself."""
    token, lower = tokens[at], tokens[at].lower()
    mark = next((t for t in tokens[max(0, at - 2) : at][::-1] if t in _AROUND_VALUE), "")
    words = [next((w.group().lower() for w in [_ANNOUNCES.search(t)] if w), "") for t in tokens[max(0, at - NEAR) : at]]
    by = next((w for w in words[::-1] if w), "")
    whole = next((t.lower() in WORDS or t.lower().endswith(("_" + w, "-" + w)) for t, w in list(zip(tokens[max(0, at - NEAR) : at], words))[::-1] if w), False)
    shape, letters = _shape(token), sum(c.isalpha() for c in token)
    kind = "mark" if len(token) == 1 and not token.isalnum() else "letters" if letters == len(token) else "digits" if token.isdigit() else "mixed"
    odd = min(_odd_pairs(token) // 2, 3)
    start = "joined" if joined else "after mark" if mark else "after word"
    return [
        "announced candidate", f"short {kind} {start}", f"short {kind} {start} odd{odd}", f"short {kind} {start} by {by} {whole}", f"short {kind} {start} whole{whole} odd{odd}", f"short shape {shape}",
        f"short length {min(len(token) // 3, 6)} {kind}", f"short mark {mark}", f"short prefix {lower.startswith(PREFIXES)} {kind}", f"short title {token.istitle()} {start}",
    ]


def _short_features(tokens: list[str], at: int) -> list[str]:
    """The features of a candidate that is short, or without a digit, and that no word announces."""
    token = tokens[at]
    # Parts of one class of characters: names and numbers have few, long ones.
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_.~-]+", token)
    size = sum(c.isalnum() for c in token)
    per = min(int(2 * size / max(1, sum(p[0].isalnum() for p in parts))), 8)
    marks = sum(not c.isalnum() for c in token)
    digits = int(4 * sum(c.isdigit() for c in token) / len(token))
    odd = min(_odd_pairs(token) // 2, 4)
    words = max((len(p) for p in parts if p.isalpha() and not _odd_pairs(p) > 5), default=0)
    inner = len(re.findall(r"[0-9](?=[A-Za-z])", token))
    form = "".join("9" if p[0].isdigit() else "." if not p[0].isalpha() else "w" if len(p) < 3 else "W" if _odd_pairs(p) < 5 else "X" for p in parts[:7])
    back, after = tokens[at - 1] if at else "^", tokens[at + 1] if at + 1 < len(tokens) else "$"
    return [
        "weak candidate", f"weak form {form}", f"weak part{per}", f"weak part{per} digits{digits}", f"weak odd{odd} part{per}", f"weak word{min(words, 7)}", f"weak word{min(words, 7)} part{per}",
        f"weak inner{min(inner, 4)}", f"weak marks{min(marks, 3)} inner{min(inner, 3)}", f"weak length{min(len(token), 16) // 2} part{per}", f"weak first {_shape(parts[0])} {len(parts) > 2}",
        f"weak digits{digits} odd{odd}", f"weak before {back if len(back) == 1 else 'word'}", f"weak after {after if len(after) == 1 else 'word'}", f"weak shape {_shape(token)} {min(len(parts), 6)}",
    ]


class Chain:
    """Weights of (tag, feature) and of pairs of tags."""

    def __init__(self):
        self.weights: dict[tuple[int, str], float] = {}
        # Inside follows only begin or inside.
        self.moves = np.zeros((3, 3))
        self.barred = np.array([[0, 0, -np.inf], [0, 0, 0], [0, 0, 0.0]])

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k, names in enumerate(features):
            for tag in (OUT, BEGIN, INSIDE):
                out[k, tag] = sum(self.weights.get((tag, m), 0.0) for m in names)
            if names[0] == "plain":
                # A mark may join two parts of a secret; a plain token never begins one.
                out[k, BEGIN] = -np.inf
                if names[1] == "plain word":
                    out[k, INSIDE] = -np.inf
        return out

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best tags, by Viterbi."""
        scores, moves = self.emissions(features), self.moves + self.barred
        best = scores[0] + np.array([0, 0, -np.inf])
        back = []
        for row in scores[1:]:
            ways = best[:, None] + moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def learn(self, features: list[list[str]], truth: list[int], past: dict, rate: float) -> None:
        """One gradient step on the log-likelihood of the true tags, scaled by past slopes."""
        scores, moves = self.emissions(features), self.moves + self.barred
        n = len(features)
        ahead, behind = np.empty((n, 3)), np.zeros((n, 3))
        ahead[0] = scores[0] + np.array([0, 0, -np.inf])
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(1, n):
                ahead[k] = np.logaddexp.reduce(ahead[k - 1][:, None] + moves, axis=0) + scores[k]
            for k in range(n - 2, -1, -1):
                behind[k] = np.logaddexp.reduce(moves + (scores[k + 1] + behind[k + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            single = np.exp(ahead + behind - total)
            pairs = np.zeros((3, 3))
            for k in range(1, n):
                pairs += np.exp(ahead[k - 1][:, None] + moves + (scores[k] + behind[k])[None, :] - total)
        slopes: dict = {}
        for k, names in enumerate(features):
            for tag in (OUT, BEGIN, INSIDE):
                change = float(truth[k] == tag) - float(single[k, tag])
                if abs(change) > 1e-4:
                    for m in names:
                        slopes[tag, m] = slopes.get((tag, m), 0.0) + change
        for key, slope in slopes.items():
            slope -= SHRINK * self.weights.get(key, 0.0)
            past[key] = past.get(key, 0.0) + slope * slope
            self.weights[key] = self.weights.get(key, 0.0) + rate * slope / (past[key] ** 0.5 + 1e-6)
        for a, b in zip(truth, truth[1:]):
            pairs[a, b] -= 1
        self.moves -= 0.02 * np.nan_to_num(pairs)


def _generated(count: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines with and without secrets, and the secrets' bounds."""
    rng = random.Random(4)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ti")) for _ in range(rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))

    def secret() -> str:
        mixed = low + up + num
        made = rng.choice([
            lambda: pick("0123456789abcdef", rng.choice([16, 18, 20, 32, 40])), lambda: pick(mixed, rng.randint(16, 44)), lambda: pick(mixed + "+/", 40),
            lambda: rng.choice(["sk_live_", "pk_live_"]) + pick(mixed, 24), lambda: rng.choice(["ghp_", "gho_", "glpat-"]) + pick(mixed, 36),
            lambda: "eyJ" + pick(mixed, 20) + "." + pick(mixed, 30) + "." + pick(mixed + "_-", 30), lambda: "xoxb-" + pick(num, 12) + "-" + pick(mixed, 24), lambda: "AIza" + pick(mixed + "_-", 35),
        ])()
        return made if is_long(made) else made[:-2] + "a7"

    def clean() -> str:
        return rng.choice([
            lambda: f"{word()}.{pick(num, 2)}@mail{pick(num, 1)}.example.com", lambda: f"https://{word()}.example.com/{word()}/{rng.randint(1900, 2030)}/{word()}",
            lambda: f"{word()}_{word()}{pick(num, 2)}_{word()}", lambda: f"{word()}-{word()}-{rng.randint(1, 99)}", lambda: f"v{pick(num, 1)}.{pick(num, 2)}.{pick(num, 1)}-{word()}{pick(num, 1)}",
            lambda: f"img_{pick(num, 8)}.jpeg", lambda: f"{rng.randint(1900, 2030)}-{pick(num, 2)}-{pick(num, 2)}T{pick(num, 2)}", lambda: f"/{word()}/{word()}{pick(num, 1)}/{word()}.txt", lambda: pick(num, 16),
            lambda: f"{word()}{word()}{word()}{pick(num, 2)}", lambda: f"ISBN{pick(num, 13)}", lambda: f"{word().title()}{word().title()}{pick(num, 1)}Test",
        ])()

    for _ in range(count):
        lead = rng.choice(["", words(rng.randint(1, 6)) + " "])
        tail = rng.choice(["", " " + words(rng.randint(1, 6)), "\n" + words(3)])
        if rng.random() < 0.5:
            name = rng.choice(["password", "db_passwd", "client_secret", "auth_token", "API_KEY", "access_key", "private key", "pwd", "credentials"])
            head = rng.choice([f"{name}=", f"{name}: ", f"{name} = \"", f"\"{name}\": \"", "Authorization: Bearer ", f"{name} is ", f"--{name} ", f"export {name.upper().replace(' ', '_')}='"])
            value = secret()
            close = '"' if head.endswith('"') else "'" if head.endswith("'") else ""
            yield lead + head + value + close + tail, [(len(lead + head), len(lead + head + value))]
        else:
            yield lead + rng.choice(["", "see ", "id=", "ref: ", "\"", "(", "key "]) + clean() + tail, []


def _announced_lines(count: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines with announcing words: with short or broken secrets after them, and with ordinary words and numbers."""
    rng = random.Random(5)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = low + low.upper() + num
    prose = (
        "features people through between government companies service protected required economy decided garden national example however different important information school "
        "management families children development question problem community international university percent building research history position without another because should before "
        "points players factors element holder reason market release message section minutes century military property investors sector equity tickets changed updated signature "
        "words board away over into under with from that this were have been their which after about would there other could first years where these around during against"
    ).split()
    said = lambda a, b: " ".join(rng.choice(prose) for _ in range(rng.randint(a, b)))

    def value() -> str:
        return rng.choice([
            lambda: pick(mixed, rng.randint(5, 14)) + pick(num, 1), lambda: pick(low + num, rng.randint(5, 10)) + pick(num, 1), lambda: pick(num, rng.randint(6, 14)), lambda: pick(low, rng.randint(8, 24)),
            lambda: pick(mixed[:52], rng.randint(7, 24)), lambda: "".join(pick(mixed, rng.randint(1, 5)) + rng.choice("!@#$%^&*?") for _ in range(rng.randint(2, 4))) + pick(mixed, rng.randint(1, 4)),
            lambda: low[rng.randint(0, 9) :][: rng.randint(8, 16)],
        ])()

    for _ in range(count):
        lead, tail = rng.choice(["", said(1, 6) + " "]), rng.choice(["", " " + said(1, 6), "\n" + said(1, 3)])
        if rng.random() < 0.5:
            name = rng.choice(["pwd", "pass", "db_pass", "user_pwd", "key", "private_key", "auth", "credential", "Pwd", "PASS", "access_key", "private key", "passphrase", "bearer"])
            head = rng.choice([f"{name}: ", f"{name}=", f"{name} = ", f"{name}:", f"{name}: \"", f"{name}='", f"\"{name}\": \"", "Authorization: Bearer ", "Bearer ", "bearer ", "Bearer "])
            found = value()
            close = head[-1] if head[-1] in "\"'" else ""
            yield lead + head + found + close + tail, [(len(lead + head), len(lead + head + found))]
        else:
            name = rng.choice(["key", "pass", "token", "private", "secret", "password", "auth", "author", "authors", "authority", "passed", "passing", "passage", "passenger", "keyboard", "keys", "keywords", "bearer", "monkey", "tokens", "Key", "Private", "secretary", "credentials"])
            after = rng.choice([
                lambda: " " + said(2, 5), lambda: ", " + said(2, 4), lambda: ". " + said(1, 3).title(), lambda: " (" + said(1, 3) + ")", lambda: " is " + said(1, 3), lambda: " of the " + said(1, 3), lambda: f" in {rng.randint(1900, 2030)} " + said(1, 3),
                lambda: f" {pick(num, 3)},{pick(num, 3)} " + said(1, 2), lambda: f" {said(1, 1)}-{said(1, 1)} " + said(1, 2), lambda: f" {said(1, 1)}'s " + said(1, 2), lambda: f" {said(1, 1)}, {said(1, 1)}. {said(1, 1)}", lambda: ": " + said(1, 1) + " " + said(1, 3),
                lambda: " " + said(1, 1).title() + " " + said(1, 2).title(), lambda: f": {said(1, 1)}, {said(1, 1)}",
                lambda: f" {said(1, 1)}.{pick(num, 2)}@mail{pick(num, 1)}.example.com{rng.choice(['', '###', '&&&', '***'])}", lambda: f" {said(4, 5)} {said(1, 1)}{pick('#&%*!', 1) * 3} {said(1, 1)}.{pick(num, 2)}@mail{pick(num, 1)}.example.com{rng.choice(['', '###', '&&&', '%%%'])}",
            ])()
            yield lead + name + after + tail, []


def _unannounced_lines(count: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines without announcing words: a quarter with a short random key, the others with names and numbers that mix classes."""
    rng = random.Random(6)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    up, mixed = low.upper(), low + low.upper() + num
    prose = (
        "river market winter station people garden theatre number window country music summer village north report player engine camera street school history letter "
        "the and was for are her his das und die der une des les que los por con was not new old day man one two red sea sun "
        "season member system village doctor energy nature planet record result search second simple travel update vector weather winner yellow bridge castle"
    ).split()
    syllable = lambda: rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ti", "or", "le", "que", "ich", "ung", "der", "ment", "eau"))
    word = lambda: rng.choice([rng.choice(prose), "".join(syllable() for _ in range(rng.randint(1, 4)))])
    said = lambda n: " ".join(word() for _ in range(n))
    numeral = lambda a, b: pick(num, rng.randint(a, b))

    def key() -> str:
        return rng.choice([
            lambda: pick(mixed, rng.randint(9, 16)), lambda: pick(mixed, rng.randint(8, 12)), lambda: pick(low + num, rng.randint(9, 11)), lambda: pick(up + num, rng.randint(9, 11)), lambda: pick("0123456789abcdef", rng.randint(10, 11)), lambda: pick("0123456789abcdef", rng.randint(10, 20)), lambda: pick(up + "234567", rng.choice([16, 26, 32])),
            lambda: pick(low + up, rng.randint(12, 28)), lambda: pick(mixed + "_-", rng.randint(10, 14)),
        ])()

    def clean() -> str:
        return rng.choice([
            lambda: f"{word()}{rng.choice('._-')}{numeral(1, 4)}@mail{numeral(1, 1)}.example.com", lambda: f"{word()}.{numeral(2, 2)}@{word()}.org", lambda: f"{word()}{numeral(1, 4)}@{word()}.com", lambda: f"{word()}{numeral(1, 4)}", lambda: f"{word()}_{numeral(1, 4)}", lambda: f"{word()}-{numeral(1, 4)}", lambda: f"{word().title()}{numeral(1, 3)}{word().title()}",
            lambda: f"{numeral(1, 4)}{rng.choice(['km', 'mg', 'px', 'th', 'GB', 'am', 'x'])}{rng.choice(['', '-', '/'])}{word()}", lambda: f"{numeral(3, 4)}x{numeral(3, 4)}", lambda: f"v{numeral(1, 1)}.{numeral(1, 2)}.{numeral(1, 2)}{rng.choice(['', '-rc1', 'b2'])}",
            lambda: f"{pick(up, rng.randint(1, 4))}{rng.choice(['', '-'])}{numeral(3, 5)}", lambda: f"{numeral(4, 4)}-{numeral(2, 2)}-{numeral(2, 2)}T{numeral(2, 2)}", lambda: word() + word().title() + rng.choice(["", word().title(), "Id", "URL"]),
            lambda: word().title() + word().title() + rng.choice(["", word().title()]), lambda: f"Mc{word().title()}son", lambda: f"{word()}{word().upper()}", lambda: f"{word().upper()}{word()}", lambda: f"{word()}/{word()}{numeral(1, 2)}", lambda: f"{word()}{numeral(1, 2)}.txt",
            lambda: f"{word()}.{word().title()}", lambda: f"{numeral(1, 3)}.{numeral(1, 2)}{rng.choice(['kg', 'MB', 'km/h', 'mm'])}", lambda: f"{pick(up, 2)}{numeral(1, 2)} {numeral(1, 1)}{pick(up, 2)}-{word()}", lambda: f"{rng.choice('QHT')}{numeral(1, 1)}-{numeral(4, 4)}", lambda: f"{numeral(2, 2)}{rng.choice(['Jan', 'Feb', 'Aug', 'Dec'])}{numeral(4, 4)}",
            lambda: f"{pick(up, 3)}-{numeral(1, 4)}-{numeral(1, 2)}", lambda: f"{word().upper()[:3]}_{numeral(8, 8)}", lambda: f"0x{pick('0123456789abcdef', 8)}", lambda: f"{numeral(4, 4)}p{numeral(2, 2)}{word()[:3]}", lambda: f"{pick(up, 1)}{numeral(1, 1)}{pick(up, 1)}{numeral(1, 1)}-{word()}",
            lambda: f"{pick(up, 1)}{numeral(1, 1)}{pick(up, 1)}-{word()}", lambda: f"{pick(up, 2)}{numeral(2, 2)}-{pick(up, 2)}{numeral(2, 2)}", lambda: f"{pick(low, 1)}{word().title()}{numeral(1, 2)}{rng.choice(['', 'Pro', 'Max', 's'])}", lambda: f"{word().title()}{numeral(2, 2)}{pick(up, 3)}",
            lambda: f"{pick(up, rng.randint(1, 2))}{word()}{word()}", lambda: f"{numeral(1, 2)}{word()}{numeral(1, 2)}", lambda: f"{word()[:4]}{numeral(1, 1)}{word()[:4]}",
        ])()

    for _ in range(count):
        lead, tail = rng.choice(["", said(rng.randint(1, 5)) + " "]) + rng.choice(["", "", "", "(", "id=", "\"", "ref: "]), rng.choice(["", " " + said(rng.randint(1, 5)), "\n" + said(2), ", " + said(1), "."])
        secret = rng.random() < 0.25
        found = key() if secret else clean()
        # A full stop would belong to the token.
        yield lead + found + tail.lstrip("."), [(len(lead), len(lead + found))] if secret and is_candidate(found) else []


def _stretch(tokens: list[re.Match], shared: list[str]) -> list[list[str]]:
    names, near = [m.group() for m in tokens], _announced(tokens)
    return [token_features(names, k, shared, near[k], k > 0 and tokens[k - 1].end() == m.start() and names[k - 1] not in _AROUND_VALUE) for k, m in enumerate(tokens)]


@functools.lru_cache(maxsize=1)
def train(examples: int = EXAMPLES) -> Chain:
    chain, past = Chain(), {}
    made = []
    for text, spans in (*_generated(examples), *_announced_lines(2 * examples), *_unannounced_lines(4 * examples)):
        tokens = list(_TOKEN.finditer(text))
        truth = [OUT] * len(tokens)
        for begin, end in spans:
            inside = [k for k, m in enumerate(tokens) if m.start() >= begin and m.end() <= end]
            for k in inside:
                truth[k] = INSIDE
            truth[inside[0]] = BEGIN
        made.append((_stretch(tokens, file_features(text)), truth))
    for _ in range(PASSES):
        for features, truth in made:
            chain.learn(features, truth, past, RATE)
    return chain


def _places(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each place that may hold candidates, in order of begins: of a token, or of what a word announces."""
    out = [m.span() for m in (*_CANDIDATE.finditer(text), *_PREFIXED.finditer(text)) if m.end() - m.start() >= SHORT]
    own = space = -1
    for m in _ANNOUNCES.finditer(text):
        # Words in one token announce the same; each search for a space begins beyond the one before.
        if m.end() > own:
            own = end = _token_end(text, m.end() - 1)
            for _ in range(NEAR):
                end = _token_end(text, end)
            if end > space:
                space = _space_after(text, end)
            out.append((m.start(), space))
    return sorted(out)


def _token_end(text: str, begin: int) -> int:
    token = _TOKEN.search(text, begin)
    return token.end() if token else len(text)


def _space_after(text: str, begin: int) -> int:
    found = _SPACE.search(text, begin)
    return found.start() if found else len(text)


def _with_before(text: str, begin: int, least: int) -> int:
    """The beginning of the word that is BEFORE words before this place's own, but not before ``least``."""
    for _ in range(BEFORE + 1):
        while begin > least and text[begin - 1].isspace():
            begin -= 1
        while begin > least and not text[begin - 1].isspace():
            begin -= 1
    return begin


def _bounds(text: str) -> Iterator[tuple[int, int]]:
    """The bounds of stretches of whole words that hold all places, what their features look at, and, after them, a
    token that parts the chain; stretches that meet are one."""
    begin = end = None
    for low, high in _places(text):
        if begin is None or low > end:
            start = _with_before(text, low, 0 if end is None else end)
            if begin is not None and start > end:
                yield begin, end
            if begin is None or start > end:
                begin = start
            end = high if end is None else max(end, high)
        if high >= end or not _PARTS_CHAIN.search(text, high, end):
            after = _PARTS_CHAIN.search(text, _space_after(text, high))
            end = max(end, _space_after(text, after.end()) if after else len(text))
    if begin is not None:
        yield begin, end


def _stretches(text: str) -> Iterator[list[re.Match]]:
    """The tokens of each stretch."""
    for begin, end in _bounds(text):
        yield list(_TOKEN.finditer(text, begin, end))


def all_spans(text: str | None, chain: Chain) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans)."""
    base = base_spans(text)
    if not text:
        return base, base
    shared, added, covered = file_features(text), [], union_of(base)
    for tokens in _stretches(text):
        tags = chain.decode(_stretch(tokens, shared))
        k = 0
        while k < len(tags):
            if tags[k] == BEGIN:
                last = k
                while last + 1 < len(tags) and tags[last + 1] == INSIDE:
                    last += 1
                begin, end = tokens[k].start(), tokens[last].end()
                if not touches(covered, begin, end):
                    added.append((ADDED, begin, end))
                k = last
            k += 1
    return base, in_order(base + added)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, begin, end) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def rows(columns: list[list]) -> Iterator[tuple]:
        for doc_id, text in zip(*columns):
            base, spans = all_spans(text, shared.value)
            yield doc_id, *([{"kind": k, "begin": b, "end": e} for k, b, e in s] for s in (base, spans))

    span = "array<struct<kind: string, begin: int, end: int>>"
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, f"doc_id long, base {span}, spans {span}")


def redacted(text: str | None, chain: Chain) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    spans = all_spans(text, chain)[1]
    if not spans:
        return text
    out, done = [], 0
    for _, begin, end in spans:
        if begin >= done:
            out += [text[done:begin], REDACTED]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in a text column replaced, in one pass over them."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    clean = by_text(lambda texts: [redacted(t, shared.value) for t in texts], "string")
    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
