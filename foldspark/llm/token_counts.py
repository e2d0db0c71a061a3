"""Token counts by a compiled finite-state transducer (operator 11).

A word BPE (lower-cased text, words that a pattern cuts, merges that mark a word's last byte) is compiled into one
deterministic transducer over characters. A state holds what the rest of a text can still depend on: whether a word is
open and of which class, what its end here would add, and, for every suffix of it that may still grow into a token, the
token before that suffix and how many tokens fewer end there. A transition is annotated with the tokens that its character adds;
where a longer token swallows shorter ones the number is negative. Two tokens may stand side by side if their own merges
would not be overtaken by one across their border; a prefix's last token is the one that may follow the encoding before
it, so no merge is replayed. States and transitions are made when first met and dropped together beyond ``MOST_STATES``;
so are transitions over whole stretches between blanks, which lead from the start state back to it.

Texts of at most ``CHUNK`` characters are walked from the start state. Longer ones are cut into chunks that become rows
of their own, dealt over all tasks. A chunk's state map gives, for each state that it may be entered in, the exit state
and the tokens between them. Maps of neighbouring chunks compose, so a text's maps are combined in a prefix scan of
logarithmic depth. Entry states are those that the characters before the chunk lead to from any place among them; a
text with an entry state outside of its map is walked as a whole instead, so counts are exact in any case.

Edge cases: a null or empty text has no bytes and no tokens; texts of any length are counted whole; repeated rows and null
ids stay as they are; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from foldspark.lineage import settle
from foldspark.llm.common import by_text, map_rows

#: Characters in a chunk; shorter texts are chunks of their own.
CHUNK = 32_768
#: Characters before a chunk from each of which its possible entry states are reached.
CONTEXT = 64
#: Tokens above which a document is over the limit.
LIMIT = 2048
#: States that a Python worker keeps; beyond this it starts afresh.
MOST_STATES = 250_000
#: Stretches between blanks that it keeps.
MOST_STRETCHES = 400_000
#: The word pattern that the transducer's classes follow (a fixed value), and its contractions.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: What stands for a special string while a text is walked: no valid text holds a lone surrogate.
_SPECIAL = "\ud800"
#: Characters below U+0300 are in normal form C in any context.
_COMPOSING = re.compile("[\u0300-\U0010ffff]")
_NFC = normalizers.NFC()
_GAP, _LETTERS, _DIGIT, _OTHERS, _MARK = range(5)
#: The open suffixes of an empty word.
_NOTHING = ((0, -1, 0),)


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones stand for themselves, others follow."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _check(parsed: dict) -> None:
    """Raise unless the definition is of the make that is compiled here."""
    model, cuts = parsed["model"], parsed["pre_tokenizer"].get("pretokenizers", [{}])
    steps = [s["type"] for s in (parsed.get("normalizer") or {}).get("normalizers", [])]
    pattern = cuts[0].get("pattern") == {"Regex": WORDS} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in parsed["added_tokens"])
    merged = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model["ignore_merges"]
    if not (steps == ["NFC", "Replace", "Lowercase"] and pattern and merged and plain and cuts[-1]["type"] == "ByteLevel"):
        raise ValueError("this is no lower-cased word BPE with the known word pattern")


class Merges:
    """The vocabulary as a trie over symbols (a byte, or a byte that ends its word), and which tokens may be neighbours."""

    def __init__(self, merges: list):
        letters = _byte_letters()
        token: dict[str, int] = {}
        spelled: list[tuple[int, ...]] = []
        for end, suffix in ((0, ""), (256, "</w>")):
            for byte, letter in enumerate(letters):
                token[letter + suffix] = len(spelled)
                spelled.append((byte + end,))
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 512
        self.joined: dict[tuple[int, int], int] = {}
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = token[left], token[right]
            if (left + right) in token:
                raise ValueError("two merges give the same token")
            self.joined[a, b] = token[left + right] = len(spelled)
            self.halves.append((a, b))
            spelled.append(spelled[a] + spelled[b])
        # Tokens are numbered by rank, so of two merges the one with the lesser token comes first.
        self.child: dict[int, int] = {}
        self.at: list[int] = [-1]
        self.grows: list[bool] = [False]
        for number, symbols in enumerate(spelled):
            node = 0
            for symbol in symbols:
                self.grows[node] = True
                key = node << 9 | symbol
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.at)
                    self.at.append(-1)
                    self.grows.append(False)
            self.at[node] = number
        self._whole: dict[int, bool] = {}
        self._beside: dict[tuple[int, int], bool] = {}

    def whole(self, token: int) -> bool:
        """Whether the merges of a token's own symbols give this token, in one piece."""
        known = self._whole.get(token)
        if known is None:
            a, b = self.halves[token]
            known = self._whole[token] = a < 0 or self.whole(a) and self.whole(b) and self._apart(a, b, token)
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether whole token ``b`` can follow whole token ``a``."""
        known = self._beside.get((a, b))
        if known is None:
            if len(self._beside) > MOST_STATES:
                self._beside.clear()
            known = self._beside[a, b] = self._apart(a, b, -1)
        return known

    def _apart(self, a: int, b: int, but: int) -> bool:
        """Whether no merge but ``but`` ever joins something across the border of two whole tokens.

        Beside the border stand, at any time, the parts made so far. Going back in time, the part that was made last
        (of two alike the right one) is opened. A pair merges across the border if its rank comes before those of the
        merges that use up its parts; of the same merge at two places the left one goes first.
        """
        used_a = used_b = len(self.halves)
        while True:
            made = self.joined.get((a, b))
            if made is not None and made != but and made < used_a and made <= used_b:
                return False
            if a > b:
                used_a, a = a, self.halves[a][1]
            elif b >= 512:
                used_b, b = b, self.halves[b][0]
            else:
                return True


class _State(dict):
    """From a character to (next state, tokens added), filled when a character is first met."""

    __slots__ = ("key", "machine")

    def __init__(self, machine: Transducer, key: tuple):
        super().__init__()
        self.machine, self.key = machine, key

    def __missing__(self, char: str) -> tuple[_State, int]:
        key, added = self.machine.after(self.key, char)
        step = self[char] = self.machine.state(key), added
        return step


class _Stretches(dict):
    """From a stretch that blanks surround to its tokens: transitions of the start state to itself."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, stretch: str) -> int:
        state, total = walk(self.machine.start, stretch)
        total = self[stretch] = total + self.machine.ended(state.key)
        return total


class Transducer:
    """The states met so far, by their keys.

    A key is (_GAP,) between words, (_MARK, letters) after an apostrophe that begins a word, or (class, tokens added if
    the word ends here, open suffixes) inside one. An open suffix is (trie node, token before it or -1, tokens before it
    less all so far).
    """

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        _check(parsed)
        self.library = Tokenizer.from_str(definition)
        self.specials = [t["content"] for t in parsed["added_tokens"]]
        self.merges = Merges(parsed["model"]["merges"])
        self.known: dict[str, list[tuple[int, str]]] = {}
        self.states: dict[tuple, _State] = {}
        self.start = self.state((_GAP,))
        self.stretches = _Stretches(self)

    def state(self, key: tuple) -> _State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State(self, key)
        return found

    def tidy(self) -> None:
        """Drop what is too much to keep; to be called between texts."""
        if len(self.states) > MOST_STATES:
            for state in self.states.values():
                state.clear()
            self.states.clear()
            self.start = self.state((_GAP,))
        if len(self.stretches) > MOST_STRETCHES:
            self.stretches.clear()

    def after(self, key: tuple, char: str) -> tuple[tuple, int]:
        """The key after a character and the tokens that it adds."""
        if char == _SPECIAL:
            return (_GAP,), self.ended(key) + 1
        total = 0
        for kind, c in self._reads(char):
            key, added = self._step(key, kind, c)
            total += added
        return key, total

    def ended(self, key: tuple) -> int:
        """The tokens that the end of what is open adds."""
        if key[0] == _GAP:
            return 0
        if key[0] == _MARK:
            return self._word("'") + (self._word(key[1]) if key[1] else 0)
        return key[1]

    def _reads(self, char: str) -> list[tuple[int, str]]:
        """What normalising makes of a character, with classes, by the library's own tables."""
        found = self.known.get(char)
        if found is None:
            found = self.known[char] = [(self._class(c), c) for c in self.library.normalizer.normalize_str(char)]
        return found

    def _class(self, char: str) -> int:
        if char == "'":
            return _MARK
        parts = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{char}{char}a"))
        return {1: _LETTERS, 2: _GAP, 3: _OTHERS, 4: _DIGIT}[parts]

    def _step(self, key: tuple, kind: int, char: str) -> tuple[tuple, int]:
        if key[0] == _MARK:
            said = key[1] + char
            if said in _ENDINGS:
                return (_GAP,), self._word("'" + said)
            if any(e.startswith(said) for e in _ENDINGS):
                return (_MARK, said), 0
            # Not a contraction: the apostrophe stands for itself, and letters read since begin a word.
            letters = key[1]
            key, total = self._open(_OTHERS, "'")
            for c in letters:
                key, added = self._step(key, _LETTERS, c)
                total += added
            key, added = self._step(key, kind, char)
            return key, total + added
        if kind == key[0] != _GAP or kind == _MARK and key[0] == _OTHERS:
            return self._grow(kind if kind != _MARK else _OTHERS, key[2], char)
        total = self.ended(key)
        if kind == _GAP:
            return (_GAP,), total
        if kind == _DIGIT:
            return (_GAP,), total + self._word(char)
        if kind == _MARK:
            return (_MARK, ""), total
        key, added = self._open(kind, char)
        return key, total + added

    def _open(self, kind: int, char: str) -> tuple[tuple, int]:
        return self._grow(kind, _NOTHING, char)

    def _word(self, word: str) -> int:
        """The tokens of a whole word."""
        key, added = self._open(_OTHERS, word)
        return added + key[1]

    def _grow(self, kind: int, open_: tuple, chars: str) -> tuple[tuple, int]:
        """The key after more characters of a word, and the tokens that they add as long as it goes on."""
        *data, last = chars.encode()
        total = 0
        for byte in data:
            open_, added = self._commit(open_, byte)
            total += added
        end = self._last(open_, last + 256)
        open_, added = self._commit(open_, last)
        return (kind, end - added, open_), total + added

    def _last(self, open_: tuple, symbol: int) -> int:
        """The tokens that a symbol adds which ends its word."""
        merges = self.merges
        child, at = merges.child, merges.at
        for node, before, less in open_:
            node = child.get(node << 9 | symbol)
            if node is not None:
                token = at[node]
                if token >= 0 and merges.whole(token) and (before < 0 or merges.beside(before, token)):
                    return less + 1
        raise AssertionError("every byte is a token")

    def _commit(self, open_: tuple, symbol: int) -> tuple[tuple, int]:
        """The open suffixes after one more symbol inside a word, and the tokens added."""
        merges = self.merges
        child, at, grows = merges.child, merges.at, merges.grows
        longer, last, added = [], -1, 0
        for node, before, less in open_:
            node = child.get(node << 9 | symbol)
            if node is not None:
                token = at[node]
                if last < 0 <= token and merges.whole(token) and (before < 0 or merges.beside(before, token)):
                    last, added = token, less + 1
                if grows[node]:
                    longer.append((node, before, less))
        if added:
            longer = [(node, before, less - added) for node, before, less in longer]
        longer.append((0, last, 0))
        return tuple(longer), added

    def prepare(self, text: str) -> str:
        """The text in normal form C, with one character for each special string."""
        if "<|" in text:
            for special in self.specials:
                text = text.replace(special, _SPECIAL)
        if not text.isascii() and _COMPOSING.search(text):
            text = _SPECIAL.join(map(_NFC.normalize_str, text.split(_SPECIAL)))
        return text.replace("\n", " ").replace("\t", " ")

    def count(self, text: str) -> int:
        """The tokens of a whole text."""
        return sum(map(self.stretches.__getitem__, self.prepare(text).split(" ")))

    def map_of(self, before: str, chunk: str) -> dict[tuple, tuple[tuple, int]]:
        """The state map of a chunk: for each key that ``before`` may leave, the key after the chunk and the tokens.

        ``before`` holds the prepared characters before the chunk, none for a text's first one. At the first blank all
        ways meet in the start state.
        """
        entries = {walk(self.start, before[k:])[0].key for k in range(len(before))} | {self.start.key}
        head, *stretches = chunk.split(" ")
        paths = self._along({key: (self.state(key), 0) for key in entries}, head)
        if not stretches:
            return {key: (state.key, total) for key, (state, total) in paths.items()}
        *stretches, tail = stretches
        out, more = walk(self.start, tail)
        more += sum(map(self.stretches.__getitem__, stretches))
        return {key: (out.key, total + self.ended(state.key) + more) for key, (state, total) in paths.items()}

    def _along(self, paths: dict, text: str) -> dict:
        """Ways through a text without blanks; those that have met in one state go on as one."""
        done, stride = 0, 64
        while done < len(text):
            part = text[done : done + stride]
            ends = {state.key: walk(state, part) for state in {s.key: s for s, _ in paths.values()}.values()}
            paths = {key: (ends[state.key][0], total + ends[state.key][1]) for key, (state, total) in paths.items()}
            done, stride = done + stride, 2 * stride
        return paths


def walk(state: _State, text: str) -> tuple[_State, int]:
    """The state after the text and the tokens added."""
    total = 0
    for char in text:
        state, added = state[char]
        total += added
    return state, total


def compose(first: dict, second: dict) -> dict:
    """The map of two neighbouring chunks; entries whose way leaves the second map are dropped."""
    return {key: (second[out][0], n + second[out][1]) for key, (out, n) in first.items() if out in second}


def total_of(maps: list[dict], start: str) -> int | None:
    """The tokens of a text from its chunks' maps in order, or None if a way leaves them.

    Neighbours are composed in levels, each half as many maps as before: a prefix scan's upward sweep.
    """
    while len(maps) > 1:
        maps = [compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return sum(maps[0][start][1:]) if start in maps[0] else None


def _packed(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _unpacked(data: bytes) -> str:
    return data.decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=1)
def _machine(definition: str) -> Transducer:
    return Transducer(definition)


def _totals(long: DataFrame, definition: str, chunk: int) -> DataFrame:
    """(digest, n_tokens) of the long texts (digest, text); n_tokens is null where a state map lacks an entry."""

    def cut(columns: list[list]) -> Iterator[tuple]:
        machine = _machine(definition)
        for digest, text in zip(*columns):
            whole = machine.prepare(text)
            for k, at in enumerate(range(0, len(whole), chunk)):
                yield digest, k, _packed(whole[max(0, at - CONTEXT) : at]), _packed(whole[at : at + chunk])

    def ways(columns: list[list]) -> Iterator[tuple]:
        machine = _machine(definition)
        for digest, k, before, part in zip(*columns):
            machine.tidy()
            found = machine.map_of(_unpacked(before), _unpacked(part))
            yield digest, k, [(repr(a), repr(b), n, machine.ended(b)) for a, (b, n) in found.items()]

    def scan(columns: list[list]) -> Iterator[tuple]:
        for digest, chunks in zip(*columns):
            maps = [{w["a"]: (w["b"], w["n"]) for w in c["ways"]} for c in sorted(chunks, key=lambda c: c["k"])]
            last = max(chunks, key=lambda c: c["k"])
            ends = {w["b"]: (None, w["ended"]) for w in last["ways"]}
            yield digest, total_of([*maps, ends], repr((_GAP,)))

    cuts = map_rows(long, cut, "digest string, k int, before binary, part binary")
    # Copies of a text have the same chunks; one of each is kept, and the shuffle deals them over all tasks.
    single = cuts.groupBy("digest", "k").agg(F.first("before").alias("before"), F.first("part").alias("part"))
    maps = map_rows(single, ways, "digest string, k int, ways array<struct<a: string, b: string, n: long, ended: long>>")
    texts = maps.groupBy("digest").agg(F.collect_list(F.struct("k", "ways")).alias("chunks"))
    return map_rows(texts, scan, "digest string, n_tokens long")


def count_tokens(docs: DataFrame, definition: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``definition`` is the tokenizer's JSON text."""

    def counts(texts: list[str]) -> list[int]:
        machine = _machine(definition)
        made = []
        for text in texts:
            machine.tidy()
            made.append(machine.count(text))
        return made

    count = by_text(counts, "long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short, long = rows.filter(F.length("text") <= chunk), rows.filter(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    totals = settle(_totals(long.select("digest", "text"), definition, chunk))
    found, missed = totals.filter(F.col("n_tokens").isNotNull()), totals.filter(F.col("n_tokens").isNull())
    parts = short.select("doc_id", "n_bytes", count("text").alias("n_tokens"))
    parts = parts.unionByName(long.select("doc_id", "n_bytes", "digest").join(found, "digest").drop("digest"))
    if not missed.isEmpty():
        again = long.join(missed.select("digest"), "digest", "left_semi")
        parts = parts.unionByName(again.select("doc_id", "n_bytes", count("text").alias("n_tokens")))
    return parts.withColumn("over_limit", F.col("n_tokens") > limit)
