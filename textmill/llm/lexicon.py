"""BPE encoding by a lexicon that is a minimal acyclic transducer, and decoding.

The frequent words of the whole input are counted, merged exactly and compiled into a minimal
transducer: a shared-suffix automaton whose arcs carry the ids that the word so far decides
(incremental construction from sorted words, as by Mihov and Maurel). It is one file of plain
arrays, which executors map into memory, one copy for all workers of a machine. A batch's words
walk it side by side, one character a step. Words that the lexicon doesn't have are merged
exactly; so results don't depend on what it holds.

Normalising and cutting into words go by tables that the tokenizer itself filled, a row for each
character. A stretch between white space that has a character out of the tables (combining marks,
what becomes several characters, rare planes) is cut by the tokenizer itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import discard, held, local_file, map_arrow, materialize, shipped_file, steps

#: Words in the lexicon, a bound on the driver's work; the distinct words that a counting task holds before it sends their counts on.
WORDS, COUNTED = 100_000, 200_000
#: Characters that the tables cover; others are cut by the tokenizer.
TABLE = 0x20000
SPACE, LETTER, NUMBER, OTHER, SPECIAL, ODD = range(6)
#: Surrogates, which no text can hold: what stands between two texts, and the special tokens in their order.
BETWEEN, FIRST_SPECIAL = 0xD8FF, 0xD800
CONTRACTIONS = "s t m d re ve ll".split()
EMPTY, DEAD = np.int64(-1), 0
COUNTS = "word string, n long"
SCHEMA = "doc_id long, ids array<int>, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """The merges of one word as they are defined: the best rank first, of equal ones the leftmost."""

    def __init__(self, definition: str) -> None:
        own = json.loads(definition)
        model = own["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges")) or own["post_processor"] or own["decoder"]:
            raise ValueError("a BPE model with word ends, no unknown token, no post-processor and no decoder is expected")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in own["added_tokens"]):
            raise ValueError("special tokens are expected to be taken from the text as it is")
        vocabulary = model["vocab"]
        self.special = [(t["content"], t["id"]) for t in own["added_tokens"]]
        self.token = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pair = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.best = {p: rank << 20 | made for p, (rank, made) in self.pair.items()}
        # The printable characters that stand for bytes, as byte-level models have them.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = [vocabulary[letter[b]] for b in range(256)]
        self.final = [vocabulary[letter[b] + "</w>"] for b in range(256)]
        self.byte = {c: b for b, c in letter.items()}

    def __call__(self, word: str) -> list[int]:
        return self.merge(word.encode())

    def shown(self, word: str) -> list[int]:
        """Of a word that is spelled in the characters that stand for bytes."""
        return self.merge(bytes(map(self.byte.__getitem__, word)))

    def merge(self, raw: bytes) -> list[int]:
        parts = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        if len(parts) > 40:
            return self.merge_long(parts)
        get = self.best.get
        due = [get(x, NEVER) for x in zip(parts, parts[1:])]
        while due and (best := min(due)) < NEVER:
            i = due.index(best)  # the leftmost
            parts[i : i + 2] = [best & MADE]
            del due[i]
            if i:
                due[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(due):
                due[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same by a queue and links, in n log n."""
        get, n = self.pair.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(x[0], i, parts[i], parts[i + 1], x[1]) for i in range(n - 1) if (x := get((parts[i], parts[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (x := get((parts[left], parts[right]))):
                    heapq.heappush(queue, (x[0], left, parts[left], parts[right], x[1]))
        return [p for p in parts if p >= 0]


#: No merge, and the bits of a merge that tell what it makes; those above are its rank.
NEVER, MADE = 1 << 60, (1 << 20) - 1


def character_tables(tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(class, normalised form) of each character below TABLE, as the tokenizer itself takes it.

    ODD are those that its neighbours may change, that become several characters, or that aren't assigned.
    """
    kinds, forms = np.full(TABLE, ODD, np.uint8), np.arange(TABLE, dtype=np.uint32)
    seconds = {int(d.split()[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    seconds |= {*range(0x1160, 0x1200)}  # vowels and finals that join a syllable
    for c in range(TABLE):
        kind = unicodedata.category(chr(c))
        if kind in ("Cn", "Cs") or unicodedata.combining(chr(c)) or c in seconds:
            continue
        form = tokenizer.normalizer.normalize_str(chr(c))
        if len(form) != 1 or ord(form) >= TABLE or ord(form) in seconds:
            continue
        forms[c] = ord(form)
        if form == " ":
            kinds[c] = SPACE
        else:
            kinds[c] = {1: LETTER, 3: NUMBER, 2: OTHER}[len(tokenizer.pre_tokenizer.pre_tokenize_str("a" + form + form))]
    kinds[BETWEEN] = SPACE
    return kinds, forms


def transducer(words: list[str], outputs: list[tuple[int, ...]]) -> tuple[list[tuple[list[tuple[str, int, tuple[int, ...]]], tuple[int, ...] | None]], int]:
    """(states, the first one): of each state its arcs (character, target, ids) and the ids at the end of a word, None where none ends.

    words: distinct, not empty, in order. States that have the same continuations are one. State 0 has no arcs: the dead end.
    """
    states: list[tuple[list[tuple[str, int, tuple[int, ...]]], tuple[int, ...] | None]] = [([], None)]
    numbers: dict[tuple, int] = {}
    # The states along the last word: arcs that may still change, and the ids at a word's end.
    arcs: list[dict[str, list]] = [{} for _ in range(max(map(len, words), default=0) + 1)]
    ends: list[tuple[int, ...] | None] = [None] * len(arcs)

    def settle(i: int) -> int:
        own = tuple((c, target, tuple(out)) for c, (target, out) in sorted(arcs[i].items()))
        key = (ends[i], own)
        if key not in numbers:
            numbers[key] = len(states)
            states.append((list(own), ends[i]))
        return numbers[key]

    def common(a: Sequence[int], b: Sequence[int]) -> int:
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    last = ""
    for word, output in zip(words, outputs, strict=True):
        shared = len(os.path.commonprefix([last, word]))
        for i in range(len(last), shared, -1):
            arcs[i - 1][last[i - 1]][0] = settle(i)
        for i in range(shared + 1, len(word) + 1):
            arcs[i], ends[i] = {}, None
            arcs[i - 1][word[i - 1]] = [0, ()]
        ends[len(word)] = ()
        for i in range(1, shared + 1):  # ids that not both words have move on to the next state
            arc = arcs[i - 1][word[i - 1]]
            n = common(arc[1], output)
            rest, arc[1], output = arc[1][n:], arc[1][:n], output[n:]
            if rest:
                for following in arcs[i].values():
                    following[1] = rest + following[1]
                if ends[i] is not None:
                    ends[i] = rest + ends[i]
        arcs[shared][word[shared]][1] = output
        last = word
    for i in range(len(last), 0, -1):
        arcs[i - 1][last[i - 1]][0] = settle(i)
    return states, settle(0)


def compiled(words: list[str], merges: Merges, kinds: np.ndarray, forms: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of the lexicon's file."""
    words = sorted(words)
    states, first = transducer(words, [tuple(merges(w)) for w in words])
    symbols = np.zeros(TABLE, np.uint16)  # 0: in no word
    for i, c in enumerate(sorted(set().union(*words)) if words else []):
        symbols[ord(c)] = i + 1
    pool: dict[tuple[int, ...], int] = {}
    size = 0

    def place(out: tuple[int, ...]) -> int:
        nonlocal size
        if out not in pool:
            pool[out] = size
            size += len(out)
        return pool[out]

    arcs = [(s << 16 | int(symbols[ord(c)]), target, place(out), len(out)) for s, (own, _) in enumerate(states) for c, target, out in own]
    ends = [(-1, 0) if end is None else (place(end), len(end)) for _, end in states]
    key, target, at, n = (np.array(x, np.int64) for x in (zip(*arcs, strict=True) if arcs else ([], [], [], [])))
    bits = max(4, (2 * len(arcs)).bit_length())
    keys, slots = np.full(1 << bits, EMPTY), np.zeros(len(arcs), np.int64)
    waiting, slot = np.arange(len(arcs)), spread(key, bits)
    while len(waiting):
        free = np.flatnonzero(keys[slot] == EMPTY)
        _, one = np.unique(slot[free], return_index=True)
        won = free[one]
        keys[slot[won]], slots[waiting[won]] = key[waiting[won]], slot[won]
        lost = np.setdiff1d(np.arange(len(waiting)), won)
        waiting, slot = waiting[lost], (slot[lost] + 1) & ((1 << bits) - 1)
    made = {"keys": keys, **{name: np.zeros(1 << bits, kind) for name, kind in (("target", np.int32), ("at", np.int32), ("n", np.int16))}}
    made["target"][slots], made["at"][slots], made["n"][slots] = target, at, n
    return made | {
        "ends_at": np.array([e[0] for e in ends], np.int32),
        "ends_n": np.array([e[1] for e in ends], np.int16),
        "pool": np.array([i for out in pool for i in out], np.int32),
        "symbols": symbols,
        "kinds": kinds,
        "forms": forms,
        "sizes": np.array([first, bits, max(map(len, words), default=0), len(words)], np.int64),
    }


def spread(key: np.ndarray, bits: int) -> np.ndarray:
    """The first slot of each key."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the arrays' names, types and places as a line of JSON, then the arrays."""
    at, about = 0, {}
    for name, a in arrays.items():
        about[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(about).encode()
    with open(path, "wb") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        start = -(-(8 + len(head)) // 64) * 64
        for name, a in arrays.items():
            out.seek(start + about[name][2])
            out.write(a.tobytes())
        out.truncate(start + at)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays, mapped into memory."""
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    start = -(-(8 + n) // 64) * 64
    about = json.loads(raw[8 : 8 + n].tobytes())
    return {name: raw[start + at : start + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in about.items()}


class Words:
    """Cuts texts into words, by tables and where these don't tell by the tokenizer."""

    def __init__(self, definition: str, kinds: np.ndarray, forms: np.ndarray) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.merges, self.kinds, self.forms = Merges(definition), kinds, forms

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised characters of all texts, and of each word its start, its end, and its kind)."""
        joined = chr(BETWEEN).join(texts)
        if "<|" in joined:
            for i, (content, _) in enumerate(self.merges.special):
                joined = joined.replace(content, chr(FIRST_SPECIAL + i))
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.full(len(raw) + 2, SPACE, np.uint8)  # white space at both ends
        beyond = raw >= TABLE
        chars = np.where(beyond, 0, raw)
        kind[1:-1] = np.where(beyond, ODD, self.kinds[chars])
        kind[1:-1][(raw >= FIRST_SPECIAL) & (raw < FIRST_SPECIAL + len(self.merges.special))] = SPECIAL
        odd = np.flatnonzero(kind == ODD)
        chars = np.where(beyond | (kind[1:-1] >= SPECIAL), raw, self.forms[chars])
        if len(odd):  # all of the stretch that holds one is left to the tokenizer
            walls = np.flatnonzero((kind == SPACE) | (kind == SPECIAL))
            which = np.unique(np.searchsorted(walls, odd))
            for a, b in zip(walls[which - 1].tolist(), walls[which].tolist(), strict=True):
                kind[a + 1 : b] = ODD
                chars[a : b - 1] = raw[a : b - 1]
        inner, before = kind[1:-1], kind[:-2]
        starts = (inner != SPACE) & ((inner != before) | (inner == NUMBER) | (inner == SPECIAL))
        at = np.flatnonzero(starts & (inner == OTHER) & (kind[2:] == LETTER) & (chars == ord("'")))
        if len(at):
            one, two = chars[at + 1], np.where(kind[at + 3] == LETTER, np.append(chars, 0)[at + 2], 0)
            size = np.zeros(len(at), np.int64)
            for c in CONTRACTIONS:
                size[(size == 0) & (one == ord(c[0])) & ((len(c) == 1) | (two == ord(c[-1])))] = len(c)
            at, size = at[size > 0], size[size > 0]
            starts[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < len(inner)]
            starts[rest[inner[rest] == LETTER]] = True
        begins = np.flatnonzero(starts)
        ends = np.flatnonzero((inner != SPACE) & (np.append(starts[1:], True) | (kind[2:] == SPACE))) + 1
        return chars, begins, ends, inner[begins]

    def odd_words(self, stretch: str) -> list[str]:
        """The words of a stretch, in the characters that stand for bytes."""
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(stretch))]


class Lexicon(Words):
    """Ids of texts by the arrays of compiled()."""

    def __init__(self, definition: str, arrays: dict[str, np.ndarray]) -> None:
        super().__init__(definition, arrays["kinds"], arrays["forms"])
        self.a = arrays
        self.first, self.bits, self.longest, _ = map(int, arrays["sizes"])
        top = max(self.merges.token) + 1
        self.tokens = [self.merges.token.get(i, "") for i in range(top)]
        self.decimals = list(map(str, range(top)))

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The slot of each state's arc by its symbol, -1 where there is none."""
        keys, mask = self.a["keys"], (1 << self.bits) - 1
        key = state.astype(np.int64) << 16 | symbol
        slot = spread(key, self.bits)
        found = keys[slot]
        open_ = np.flatnonzero((found != key) & (found != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found[open_] = keys[slot[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] != EMPTY)]
        slot[found != key] = -1
        return slot

    def walk(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """All words at once, the longest first: (whether each ends in a word's end, the arcs' slots at each step, the last states)."""
        state, path = np.full(len(begins), self.first, np.int64), []
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, "left"))  # so many are longer
            slot = self.follow(state[:n], symbols[begins[:n] + step])
            state[:n] = np.where(slot < 0, DEAD, self.a["target"][slot])
            path.append(slot)
        return self.a["ends_at"][state] >= 0, path, state

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        chars, begins, ends, kinds = self.cut(texts)
        sizes = ends - begins
        count = np.zeros(len(begins), np.int64)
        plain = np.flatnonzero((kinds < SPECIAL) & (sizes <= self.longest))
        plain = plain[np.argsort(-sizes[plain], kind="stable")]
        symbols = self.a["symbols"][np.minimum(chars, TABLE - 1)]
        good, path, state = self.walk(symbols, begins[plain], sizes[plain])
        for slot in path:
            n = len(slot)
            count[plain[:n]] += np.where(good[:n], self.a["n"][slot], 0)
        count[plain] += np.where(good, self.a["ends_n"][state], 0)
        # The others: special tokens, words that the lexicon lacks, and stretches that the tokenizer cuts.
        known = np.zeros(len(begins), bool)
        known[plain[good]] = True
        made: dict[tuple[int, str], list[int]] = {}
        other: list[tuple[int, list[int]]] = []
        for w in np.flatnonzero(~known).tolist():
            kind, word = int(kinds[w]) if kinds[w] >= SPECIAL else 0, chars[begins[w] : ends[w]]
            if kind == SPECIAL:
                own = [self.merges.special[int(word[0]) - FIRST_SPECIAL][1]]
            else:
                text = word.tobytes().decode("utf-32-le")
                own = made.get((kind, text))
                if own is None:
                    own = made[kind, text] = [i for x in self.odd_words(text) for i in self.merges.shown(x)] if kind == ODD else self.merges(text)
            count[w] = len(own)
            other.append((w, own))
        places = np.concatenate(([0], np.cumsum(count)))
        ids = np.zeros(int(places[-1]), np.int32)
        filled = places[:-1][plain].copy()
        for slot, at, n in [*((s, self.a["at"], self.a["n"]) for s in path), (state, self.a["ends_at"], self.a["ends_n"])]:
            own = np.flatnonzero(good[: len(slot)])
            own = own[n[slot[own]] > 0]
            many = n[slot[own]].astype(np.int64)
            for i in range(int(many.max(initial=0))):
                some = own[many > i]
                ids[filled[some] + i] = self.a["pool"][at[slot[some]] + i]
            filled[own] += many
        for w, own in other:
            ids[places[w] : places[w + 1]] = own
        # Where each text's first word is: words begin at or behind the text's first character.
        lengths = np.diff(np.concatenate(([-1], np.flatnonzero(chars == BETWEEN), [len(chars)])))
        borders = np.searchsorted(begins, np.concatenate(([0], np.cumsum(lengths))))
        borders[-1] = len(begins)
        return [ids[places[a] : places[b]] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder does it."""
        return " ".join(map(self.tokens.__getitem__, ids))


def word_counts(df: DataFrame, definition: str, tables: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: each task sends the counts of its distinct words, now and then so that they stay bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Words:
            found = load(local_file(tables))
            return Words(definition, found["kinds"], found["forms"])

        words, counts = held(("cut", tables), make), Counter()
        for batch in steps(batches, "text"):
            chars, begins, ends, kinds = words.cut([x or "" for x in batch.column("text").to_pylist()])
            text = chars.tobytes().decode("utf-32-le", "surrogatepass")
            plain = kinds < SPECIAL
            counts.update([text[a:b] for a, b in zip(begins[plain].tolist(), ends[plain].tolist(), strict=True) if b - a <= LONGEST])
            if len(counts) > COUNTED:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    return map_arrow(df.select(F.col(text_col).cast("string").alias("text")), run, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


#: Longer words aren't looked for in the lexicon.
LONGEST = 32


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _ship(spark: SparkSession, arrays: dict[str, np.ndarray], label: str) -> str:
    """The arrays' file, sent along with the application under a name that tells its contents."""
    digest = hashlib.sha256(b"".join(name.encode() + a.tobytes() for name, a in arrays.items())).hexdigest()[:16]
    path = os.path.join(tempfile.mkdtemp(prefix="textmill-lexicon-"), f"{label}-{digest}.bin")
    save(arrays, path)
    return shipped_file(spark, path)


def build(df: DataFrame, tokenizer: str, words: int = WORDS, text_col: str = "text") -> str:
    """Counts the words of all texts, compiles the `words` most frequent ones and ships the file, whose name it returns.

    The least frequency that no more than so many words have is found by a histogram, whose few rows
    and then at most `words` words come to the driver; of words that come once none is taken.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    kinds, forms = character_tables(Tokenizer.from_str(definition))
    tables = _ship(df.sparkSession, {"kinds": kinds, "forms": forms}, "characters")
    counts = materialize(word_counts(df, definition, tables, text_col).where("n > 1"), "word-counts")
    step = F.floor(16 * F.log2(F.col("n"))).cast("int")
    least, room = None, words
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 16 rows for each power of two
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    frequent = counts.where(step >= least).select("word").collect() if least is not None else []
    discard(counts)
    return _ship(df.sparkSession, compiled([r["word"] for r in frequent], Merges(definition), kinds, forms), "lexicon")


def encode_words(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, lexicon: str | None = None, words: int = WORDS) -> DataFrame:
    """SCHEMA: each row's ids and what they decode to, with digests of both.

    One row out for each row in. A null or empty text has no ids and decodes to an empty text.
    Null ids of rows are carried along, repeated rows stay, other columns are left out. With
    ids=False the ids and the decoded text are left null, for queries that need the digests alone.
    An empty table gives an empty result. Unless a lexicon of build() is named, the input is read
    a first time to count its words, whose counts are the one shuffle; batches are
    bounded, a longer text is held whole.
    """
    name = lexicon or build(df, tokenizer, words, text_col)
    model = shipped_file(df.sparkSession, tokenizer)

    def make() -> Lexicon:
        with open(local_file(model), encoding="utf-8") as file:
            return Lexicon(file.read(), load(local_file(name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(("lexicon", name), make)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in steps(batches, "text"):
            made = [x.tolist() for x in own.encode_all([x or "" for x in batch.column("text").to_pylist()])]
            decoded = list(map(own.decode, made))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.array(made if ids else [None] * len(made), pa.list_(pa.int32())),
                    "decoded": pa.array(decoded if ids else [None] * len(made), pa.string()),
                    "n_tokens": pa.array(list(map(len, made)), pa.int64()),
                    "ids_sha256": pa.array([sha(" ".join(map(own.decimals.__getitem__, x))) for x in made]),
                    "decoded_sha256": pa.array(list(map(sha, decoded))),
                }
            )

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)
