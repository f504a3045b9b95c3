"""Toxicity: a noisy-channel decoder restores disguised words, and the restored text is scored."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may stand between the letters of one word.
FILLERS = "._-*~^'`,"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A state of the character model: a letter, any other letter, or a word's edge.
OTHER, EDGE = 26, 27
STATES = 28

#: Labelled rows, about, that the two weights of the last step are fitted on.
SAMPLE_ROWS = 20_000
#: Features in fewer toxic training rows than this have no weight, whatever the input.
LEAST_ROWS = 4
#: Features in at least this share of the toxic training rows are heavy: the share bounds how many there are. They go with
#: every pass; the weights of all others go page by page.
HEAVY_SHARE = 0.001
#: Weights of a page, about: the first goes with the pass over the texts, each further one with a pass over what is left
#: to look up.
PAGE = 1 << 18
#: Bits of the filters of features.
FILTER_BITS = 1 << 22
PREFIXES = (4, 5, 6, 7)
TOP = 5

_LETTER_RUN = re.compile(r"[^\W\d_]+")
#: One character, with a filler at most: three or more in a row may be a spaced word.
_SHORT = r"(?s)^.[._\-*~^'`,]?$"
#: What can stand for a letter; what has none isn't decoded.
_LEGIBLE = re.compile("[^\\W\\d_]|[" + re.escape("".join(SIGNS)) + "]")
#: What stands for nothing.
_MUTE = re.compile("[\\W\\d_]")
_DOUBLE = "|".join(c + c for c in LETTERS)
_TWICE, _THRICE = re.compile(r"([a-z])\1"), re.compile(r"([a-z])\1\1")
_AGAIN = re.compile(r"(.)\1")
#: Marks at the ends of a token that stand for no letter.
_ENDS = ".,;:?)\"'"
#: Disguised tokens whose restorations a worker remembers.
REMEMBERED = 100_000
#: Words with a doubled letter in so many rows, and so large a share of the rows of all such words, are spelled so: they
#: aren't decoded, and their own weights count. The share bounds how many there are.
USUAL_ROWS, USUAL_SHARE = 25, 1 / 20_000
#: Bytes of text that are read at once; a longer text goes alone.
SLICE_BYTES = 5 << 20
#: Ends a string that only its beginnings are known of.
OPEN = "*"

_P = np.uint64(0x9E3779B97F4A7C15)


_STATE = {c: i for i, c in enumerate(LETTERS)}


def state(ch: str) -> int:
    return _STATE.get(ch, OTHER)


@dataclass(frozen=True)
class Read:
    """Texts as tokens in lower case: the distinct ones with and without the marks at their ends, and for each place
    the row, the token and the bare token."""

    tokens: pa.Array
    bare: pa.Array
    row: np.ndarray
    token: np.ndarray
    word: np.ndarray


def read(texts: pa.Array) -> Read:
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat = split.flatten().dictionary_encode()
    bare = pc.utf8_trim(flat.dictionary, _ENDS).dictionary_encode()
    token = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(split.offsets.to_numpy()))
    return Read(flat.dictionary, bare.dictionary, row, token, bare.indices.to_numpy()[token])


def sliced(batches: Iterator[pa.RecordBatch], column: str = "_text") -> Iterator[tuple[pa.RecordBatch, Read]]:
    """The rows of the batches in slices of bounded size, and their texts read."""
    pa.set_cpu_count(1)
    for batch in batches:
        for first, stop in C.slices(batch.column(column), SLICE_BYTES):
            part = batch.slice(first, stop - first)
            yield part, read(part.column(column))


def rows_of(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, key) pairs of keys from 0 to n - 1."""
    pairs = np.unique(row.astype(np.int64) * max(n, 1) + keys)
    return pairs // max(n, 1), pairs % max(n, 1)


def trigram_counts(tokens: list[str], times: np.ndarray) -> np.ndarray:
    """Counts of three states in a row over tokens, each as often as it stands in the texts."""
    table = np.full(256, EDGE, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[128:] = OTHER
    line = "".join(["  ", *(t + "  " for t in tokens)])
    a = table[np.frombuffer(line.encode("latin-1", "replace"), np.uint8)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    # A trigram belongs to the token that its last state is of, or whose end that is.
    weight = np.repeat(times, lengths)
    return np.bincount(a[:-2] * STATES * STATES + a[1:-1] * STATES + a[2:], weights=weight, minlength=STATES**3).astype(np.int64)


class Channel:
    """Viterbi decoding of disguised words: signs for letters, letters repeated, signs or spaces between letters.

    The lattice has, at each character, the letters that it may stand for, the letter before again (a repetition), or
    nothing (a filler). The path of least cost under the character model, plus the costs of the channel, is the word.
    """

    REPEAT, SIGN, FILLER, TWICE = 1.0, 1.0, 0.5, 1.5

    def __init__(self, counts: np.ndarray, usual: frozenset[str] = frozenset()):
        self.usual = usual
        c = counts.reshape(STATES, STATES, STATES).astype(float)
        pairs = c.sum(0)
        back = (pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True)
        p = (c + 5 * back[None]) / (c.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p)).tolist()

    @staticmethod
    def choices(ch: str) -> str:
        return ch if ch.isalpha() else SIGNS.get(ch, "")

    def decode(self, token: str, repeats: bool = True) -> str:
        """The word that a token stands for; in lower case. Linear in the token's length. Without repeats, each letter
        and sign that is written again counts again."""
        if repeats and token.isalpha() and not _THRICE.search(token):
            return self.undoubled(token)
        cost, n, i = self.cost, len(token), 0
        beams: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(EDGE, EDGE): (0.0, None, "")}
        while i < n:
            ch = token[i]
            again = i > 0 and ch == token[i - 1]
            if len(beams) == 1 and not again and ch.isalpha():  # one path, as far as letters leave no choice
                (((a, b), node),) = beams.items()
                total, first = node[0], i
                while ch.isalpha() and (i == first or ch != token[i - 1]):
                    s = state(ch)
                    total += cost[a][b][s]
                    a, b = b, s
                    i += 1
                    if i == n:
                        break
                    ch = token[i]
                beams = {(a, b): (total, node, token[first:i])}
                continue
            new: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
            options = [(x, state(x), 0.0 if x == ch else self.SIGN) for x in self.choices(ch)]
            repeated = state(options[0][0] if options else ch) if repeats and again else -1
            mute = self.FILLER + (0.0 if ch in FILLERS or not options else 2.0) if not options or ch in FILLERS or (i in (0, n - 1) and not ch.isalpha()) else None
            for at, node in beams.items():
                a, b = at
                for letter, s, sign in options:
                    v = node[0] + cost[a][b][s] + sign + (self.TWICE if repeated >= 0 and s == b else 0.0)
                    if (b, s) not in new or v < new[b, s][0]:
                        new[b, s] = (v, node, letter)
                if repeated == b < OTHER and (at not in new or node[0] + self.REPEAT < new[at][0]):
                    new[at] = (node[0] + self.REPEAT, node, "")
                if mute is not None and (at not in new or node[0] + mute < new[at][0]):
                    new[at] = (node[0] + mute, node, "")
            beams = new
            i += 1
        if not beams:
            return token
        end = min(beams, key=lambda k: beams[k][0] + cost[k[0]][k[1]][EDGE])
        node, out = beams[end], []
        while node is not None:
            out.append(node[2])
            node = node[1]
        return "".join(reversed(out))

    def undoubled(self, token: str) -> str:
        """decode() of letters that stand twice at most: after the letter that follows a double both paths are in one
        state, so each double is decided by itself."""
        cost, out, done = self.cost, [], 0
        for m in _TWICE.finditer(token):
            i = m.start()
            a, b = state(token[i - 1]) if i else EDGE, state(m[1])
            n = state(token[i + 2]) if i + 2 < len(token) else EDGE
            if self.REPEAT + cost[a][b][n] < cost[a][b][b] + self.TWICE + cost[b][b][n]:
                out.append(token[done : i + 1])
                done = i + 2
        return "".join(out) + token[done:] if out else token

    def cost_of(self, word: str) -> float:
        """Of a word as the character model sees it, with its end."""
        a, b, total = EDGE, EDGE, 0.0
        for s in map(state, word):
            total += self.cost[a][b][s]
            a, b = b, s
        return total + self.cost[a][b][EDGE]

    def segmented(self, run: str) -> list[str]:
        """The words that a run of letters without spaces is most likely made of; linear in its length."""
        beams: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(EDGE, EDGE): (0.0, None, "")}
        for i, ch in enumerate(run):
            s, new = state(ch), {}
            for (a, b), node in beams.items():
                ways = [((b, s), node[0] + self.cost[a][b][s], ch)]
                if i:
                    ways.append(((EDGE, s), node[0] + self.cost[a][b][EDGE] + self.cost[EDGE][EDGE][s], " " + ch))
                for at, v, text in ways:
                    if at not in new or v < new[at][0]:
                        new[at] = (v, node, text)
            beams = new
        end = min(beams, key=lambda k: beams[k][0] + self.cost[k[0]][k[1]][EDGE])
        node, out = beams[end], []
        while node is not None:
            out.append(node[2])
            node = node[1]
        return "".join(reversed(out)).split()

    def readings(self, token: str) -> tuple[str, ...]:
        """What a token stands for, with what is written again as one letter and as more."""
        if not _AGAIN.search(token):
            return (self.decode(token),)
        return self.decode(token), token if token.isalpha() else self.decode(token, repeats=False)

    def restored(self, token: str) -> tuple[str, ...]:
        """The words of a token in lower case that is not plain letters, or has a doubled one, and what it stands for."""
        if token.isalpha():
            return tuple({token, self.decode(token)})
        words = set(_LETTER_RUN.findall(token))
        if _LEGIBLE.search(token):
            # Signs that stand for no letter cost the same wherever they are: without them more tokens are alike.
            heard = _MUTE.sub(lambda m: m[0] if m[0] in SIGNS or m[0] in FILLERS else "", token)
            for word in (heard,) if heard.isalpha() and not _AGAIN.search(heard) else self._remember(heard):
                words.update(_LETTER_RUN.findall(word))
        return tuple(words)

    def unspaced(self, run: str) -> tuple[str, ...]:
        """The words of a run of single characters: all of it, its likely words, and what may begin at each of them."""
        words: set[str] = set()
        for reading in self._remember(run):
            for letters in _LETTER_RUN.findall(reading):
                words.add(letters)
                words.update(self.segmented(letters))
                words.update(letters[i : i + PREFIXES[-1]] + OPEN for i in range(len(letters) - PREFIXES[0] + 1))
        return tuple(words)

    def _remember(self, token: str) -> tuple[str, ...]:
        if len(token) > 64:
            return self.readings(token)
        known = self.__dict__.setdefault("_known", {})
        if token not in known:
            if len(known) > REMEMBERED:
                known.clear()
            known[token] = self.readings(token)
        return known[token]

    def __getstate__(self) -> dict:
        return {"cost": self.cost, "usual": self.usual}

    def words(self, r: Read, wanted: Callable[[Features], np.ndarray], join: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[Features, np.ndarray, np.ndarray]:
        """The features of the words that texts have and that their disguised tokens stand for, and the distinct pairs
        (row, word) of wanted words. join tells of hashes of whole words whether two tokens in a row that make one are
        worth a look; they count as a word where that is likelier than two."""
        plain = pc.and_(pc.utf8_is_alpha(r.bare), pc.invert(pc.match_substring_regex(r.bare, _DOUBLE))).to_numpy(zero_copy_only=False)
        words = r.bare.to_pylist()
        number = {w: i for i, w in enumerate(words)}
        more: list[tuple[int, tuple[str, ...]]] = []  # (token, its words)
        for i in np.flatnonzero(~plain).tolist():
            w = words[i]
            if w in self.usual:
                plain[i] = True
            elif w:
                more.append((i, self.restored(w)))
        rows, extra = [], len(words)  # of what isn't a single token
        for row, run in spaced(r):
            rows.append(row)
            more.append((extra + len(rows) - 1, self.unspaced(run)))
        if join:
            for row, a, b in joined(r, words, plain, join):
                if self.cost_of(a + b) + self.FILLER < self.cost_of(a) + self.cost_of(b):
                    rows.append(row)
                    more.append((extra + len(rows) - 1, (a + b,)))
        # token -> its words: itself where it is plain, else the ones in `more`.
        n_tokens = extra + len(rows)
        counts = np.zeros(n_tokens, np.int64)
        counts[:extra] = plain
        flat = []
        for i, ws in more:
            counts[i] = len(ws)
            flat += [number.setdefault(w, len(number)) for w in ws]
        words = list(number)
        ends = np.cumsum(counts)
        of = np.empty(ends[-1] if n_tokens else 0, np.int64)
        own = np.flatnonzero(plain)
        of[ends[own] - 1] = own
        other = np.array([i for i, ws in more if ws], np.int64)
        if len(other):
            of[C.ragged(ends[other] - counts[other], counts[other])] = flat

        f = features(words)
        hit = wanted(f)
        some = np.concatenate([[0], np.cumsum(hit[of])])
        token_hit = some[ends] > some[ends - counts]
        at = np.flatnonzero(token_hit[r.word])
        row, token = np.concatenate([r.row[at], np.array(rows, np.int64)]), np.concatenate([r.word[at], extra + np.arange(len(rows))])
        row, token = rows_of(token, row, n_tokens)
        row, word = np.repeat(row, counts[token]), of[C.ragged(ends[token] - counts[token], counts[token])]
        keep = hit[word]
        return f, *rows_of(word[keep], row[keep], len(words))


def spaced(r: Read) -> Iterator[tuple[int, str]]:
    """(row, characters) of three or more single characters in a row."""
    short = pc.match_substring_regex(r.tokens, _SHORT).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(short[r.token])
    if not len(at):
        return
    first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(r.row[at]) > 0)])
    starts = np.flatnonzero(first)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        if b - a > 2:
            yield int(r.row[at[a]]), "".join(r.tokens[i].as_py()[0] for i in r.token[at[a:b]].tolist())


def joined(r: Read, words: list[str], plain: np.ndarray, join: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, str, str]]:
    """(row, a, b) of two plain tokens in a row whose whole may be a word worth a look, each pair once for each row."""
    value, power = polynomials(words)
    a, b = r.word[:-1], r.word[1:]
    at = np.flatnonzero((r.row[:-1] == r.row[1:]) & plain[a] & plain[b])
    a, b = a[at], b[at]
    hit = np.flatnonzero(join(whole(value[a] + power[a] * value[b])))
    for row, x, y in sorted(set(zip(r.row[at[hit]].tolist(), a[hit].tolist(), b[hit].tolist(), strict=True))):
        yield row, words[x], words[y]


def polynomials(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the sum of its characters times powers of a constant, and the next power."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sums, starts = running(words, lengths)
    powers = power_of(lengths)
    return sums[starts + lengths] - sums[starts], powers[lengths]


def power_of(lengths: np.ndarray) -> np.ndarray:
    """The powers of the constant, as many as the longest word takes."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(lengths.max(initial=0), _P)]), dtype=np.uint64)


def running(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over the characters of all words, and where each word starts."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    powers = power_of(lengths)
    place = np.arange(len(chars)) - np.repeat(starts, lengths)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * powers[place], dtype=np.uint64)]), starts


def whole(value: np.ndarray) -> np.ndarray:
    return _mixed(value)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Features:
    """64-bit hashes of the features of words, word by word: the word as a whole, and its beginnings."""

    words: list[str]
    word: np.ndarray
    hash: np.ndarray

    def any(self, hit: np.ndarray) -> np.ndarray:
        """Of each word whether one of its features is hit."""
        return np.bincount(self.word[hit], minlength=len(self.words)) > 0


def features(words: list[str]) -> Features:
    open_ = np.fromiter((w.endswith(OPEN) for w in words), bool, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sums, starts = running(words, lengths)
    lengths = lengths - open_
    at, hashes = [np.flatnonzero(~open_)], []
    hashes.append(whole(sums[starts[at[0]] + lengths[at[0]]] - sums[starts[at[0]]]))
    for n in PREFIXES:
        has = np.flatnonzero(lengths >= n)
        at.append(has)
        hashes.append(_mixed((sums[starts[has] + n] - sums[starts[has]]) ^ np.uint64(n << 56)))
    return Features(words, np.concatenate(at), np.concatenate(hashes))


class Filter:
    """Features that may be in a table: all that are, and few others. Its size is fixed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, table: DataFrame) -> Filter:
        bit = F.pmod(F.col("feature"), F.lit(FILTER_BITS))
        found = table.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).collect()
        words = np.zeros(FILTER_BITS // 32, "<u4")
        for r in found:
            words[r["at"]] = r["bits"]
        return cls(words.view(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes % np.uint64(FILTER_BITS)
        return (self.bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Weights:
    """Features and their weights, as arrays."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(features)
        self.keys, self.weights = features[order], weights[order]

    @classmethod
    def of(cls, table: DataFrame) -> Weights:
        found = table.select("feature", "weight").toArrow()
        return cls(found["feature"].to_numpy().astype(np.int64).view(np.uint64), found["weight"].to_numpy().astype(float))

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        """0 for features that aren't here."""
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.weights[at], 0.0)


class Scorer(Weights):
    """Weights of heavy features; all others are in a table (feature, weight)."""

    def evidence(self, channel: Channel, r: Read, rows: int, page: Weights, later: Filter | None) -> list[tuple[list, list, list, list]]:
        """For each row the largest weights of words that no later page can change; and of all others a number, the weight
        so far and the features to look up."""
        weight = lookups = None

        def wanted(f: Features) -> np.ndarray:
            nonlocal weight, lookups
            w = np.maximum(self.weight(f.hash), page.weight(f.hash))
            lookups = (w == 0) & later.has(f.hash) if later else np.zeros(len(w), bool)
            weight = np.zeros(len(f.words))
            np.maximum.at(weight, f.word, w)
            return (weight > 0) | f.any(lookups)

        f, row, word = channel.words(r, wanted, lambda whole: self.weight(whole) > 0)
        look = np.flatnonzero(lookups)
        look = look[np.argsort(f.word[look], kind="stable")]
        starts = np.searchsorted(f.word[look], np.arange(len(f.words) + 1)).tolist()
        hashes = f.hash[look].view(np.int64).tolist()
        out: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in range(rows)]
        for i, w, v in zip(row.tolist(), word.tolist(), weight[word].tolist(), strict=True):
            sure, numbers, so_far, features_ = out[i]
            a, b = starts[w], starts[w + 1]
            if a < b:
                numbers += [w] * (b - a)
                so_far += [v] * (b - a)
                features_ += hashes[a:b]
            else:
                sure.append(v)
        return [(sorted(sure, reverse=True)[:TOP], *rest) for sure, *rest in out]


def pages(table: DataFrame) -> list[DataFrame]:
    """Parts of a written table of weights, by their hashes, of about PAGE rows at most."""
    n = math.ceil(table.count() / PAGE)
    return [table.where(F.pmod("feature", F.lit(n)) == i) for i in range(n)] if n > 1 else [table]


def looked_up(page: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Evidence with the weights of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column("so_far")
            hashes = b.column("lookups").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            new = np.maximum(old.flatten().to_numpy(zero_copy_only=False), page.weight(hashes))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(old).to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield b.set_column(b.schema.get_field_index("so_far"), "so_far", pa.ListArray.from_arrays(pa.array(ends), pa.array(new)))

    return run


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence with all weights known: the largest of each row's words."""
    for b in batches:
        best = []
        for sure, numbers, so_far in zip(*(b.column(c).to_pylist() for c in ("sure", "numbers", "so_far")), strict=True):
            of: dict[int, float] = {}
            for i, v in zip(numbers, so_far, strict=True):
                of[i] = max(v, of.get(i, 0.0))
            best.append(sorted([*sure, *(v for v in of.values() if v > 0)], reverse=True)[:TOP])
        yield b.select([0]).append_column("sure", pa.array(best, pa.list_(pa.float64())))


def evidence_of(rows: DataFrame, keep: str, kind: str, channel: Channel, scorer: Scorer, table: DataFrame) -> DataFrame:
    """(keep, top, some) for each of rows (keep, _text): the largest weight, and the sum of the largest few, each word
    counting once with its strongest feature. Weights come to the rows, so nothing is shuffled by feature."""
    first, *rest = pages(table)
    page, later = Weights.of(first), Filter.of(reduce(DataFrame.union, rest)) if rest else None
    types = [pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64())]
    names = ["sure", "numbers", "so_far", "lookups"]
    schema = f"{keep} {kind}, sure array<double>, numbers array<int>, so_far array<double>, lookups array<long>"

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, r in sliced(batches):
            found = zip(*scorer.evidence(channel, r, len(part), page, later), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(keep), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], names=[keep, *names])

    found = C.written(rows.select(keep, "_text").mapInArrow(seen, schema), "toxic-evidence")
    for part in rest:
        found = C.written(found.mapInArrow(looked_up(Weights.of(part)), schema), "toxic-evidence")
    if rest:
        found = found.mapInArrow(folded, f"{keep} {kind}, sure array<double>")
    return found.select(keep, F.coalesce(F.get("sure", F.lit(0)), F.lit(0.0)).alias("top"), F.aggregate("sure", F.lit(0.0), lambda x, y: x + y).alias("some"))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """Newton's method with a small ridge; the last coefficient is the constant."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.array([1e-3, 1e-3, 1e-6])
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist()) if len(x) else (1.0, 0.0, -5.0)


def fold(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def channel_of(docs: DataFrame) -> Channel:
    """The channel with a character model of all rows of docs (_text), and the usual words with doubled letters. The
    driver gets STATES**3 sums and 1 / USUAL_SHARE words at most."""
    schema = pa.schema([("at", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(STATES**3, np.int64)
        for _, r in sliced(batches):
            n += trigram_counts(r.tokens.to_pylist(), np.bincount(r.token, minlength=len(r.tokens)))
            doubled = pc.and_(pc.utf8_is_alpha(r.bare), pc.match_substring_regex(r.bare, _DOUBLE)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(doubled[r.word])
            words, rows = np.unique(rows_of(r.word[at], r.row[at], len(r.bare))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), -1)), r.bare.take(pa.array(words)).cast(pa.string()), pa.array(rows)], schema=schema)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([""] * len(at), pa.string()), pa.array(n[at])], schema=schema)

    # Read twice: the sums, and the words that have their share.
    sums = C.written(docs.select("_text").mapInArrow(count, "at long, word string, n long").groupBy("at", "word").agg(F.sum("n").alias("n")), "toxic-channel")
    counts = np.zeros(STATES**3, np.int64)
    for r in sums.where("at >= 0").collect():
        counts[r["at"]] = r["n"]
    words = sums.where("at < 0")
    least = max(USUAL_ROWS, math.ceil(USUAL_SHARE * (words.agg(F.sum("n")).first()[0] or 0)))
    return Channel(counts, frozenset(r["word"] for r in words.where(F.col("n") >= least).select("word").collect()))


def feature_counts(rows: DataFrame, channel: Channel, only: Filter | None = None) -> DataFrame:
    """(feature, n): in how many rows each feature stands, of those that may be in only; partial counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in sliced(batches):
            seen = np.empty(0, bool)

            def wanted(f: Features) -> np.ndarray:
                nonlocal seen
                seen = only.has(f.hash) if only else np.ones(len(f.hash), bool)
                return f.any(seen)

            f, row, word = channel.words(r, wanted)
            hashes, number = np.unique(f.hash[seen], return_inverse=True)
            order = np.argsort(f.word[seen], kind="stable")
            counts = np.bincount(f.word[seen], minlength=len(f.words))
            starts = np.cumsum(counts) - counts
            of = number[order][C.ragged(starts[word], counts[word])]
            n = np.bincount(rows_of(of, np.repeat(row, counts[word]), len(hashes))[1], minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["feature", "n"])

    return rows.select("_text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, labels: DataFrame, channel: Channel, sample_rows: int) -> tuple[Scorer, DataFrame, tuple[float, float, float]]:
    """docs: _id, _text, of the training rows only; labels: _id, toxic. Three quarters of the labelled rows count the
    features, all of them; the rest, a bounded sample, fits the logistic. Returns the scorer, the table of the weights
    that it doesn't hold, and the coefficients."""
    # The labels are never broadcast: how many there are grows with the input, and all sizes take one plan.
    rows = C.written(docs.hint("merge").join(labels, "_id").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(4))), "toxic-rows")
    bad, good = rows.where("toxic = 1 AND _part > 0"), rows.where("toxic = 0 AND _part > 0")
    n_bad, n_good = bad.count(), good.count()
    in_bad = C.written(feature_counts(bad, channel).where(F.col("n") >= LEAST_ROWS), "toxic-features")
    in_good = feature_counts(good, channel, Filter.of(in_bad)).withColumnRenamed("n", "n2")
    weight = F.log((F.col("n") + 0.1) / (n_bad + 0.2)) - F.log((F.coalesce("n2", F.lit(0)) + 0.5) / (n_good + 1))
    weights = C.written(in_bad.hint("merge").join(in_good, "feature", "left").select("feature", "n", weight.alias("weight")).where("weight > 1"), "toxic-weights")
    heavy = F.col("n") >= max(LEAST_ROWS, math.ceil(HEAVY_SHARE * n_bad))
    table = weights.where(~heavy).select("feature", "weight")
    scorer = Scorer.of(weights.where(heavy))
    part = C.hashed_sample(rows.where("_part = 0"), "_id", sample_rows)
    seen = evidence_of(part, "toxic", "int", channel, scorer, table).toPandas().sort_values(["top", "some", "toxic"])
    return scorer, table, fit_logistic(seen[["top", "some"]].to_numpy(float), seen["toxic"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_fold: int = 2, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Tokens that look disguised are decoded by Viterbi under a character model of all texts; words and beginnings of
    words, of the text and of what was restored, are weighed by the odds that labelled training rows give them. A
    logistic over the strongest weights is the score. Only the text goes into a score.

    Null or empty text has no evidence and gets the constant's score. Null ids aren't held out or labelled by fold 2 of
    4 (the empty id is in fold 0) and never labelled. Of repeated labels the larger counts. Without toxic labels all
    scores are low. Repeated rows get equal scores. An empty table gives an empty table; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("_id"), C.text_of(text_col).alias("_text"))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(fold("_id", folds) != held_fold).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    channel = channel_of(src)
    scorer, table, (a, b, c) = trained(src.where(F.col("_id").isNotNull() & (fold("_id", folds) != held_fold)), known, channel, sample_rows)

    out = evidence_of(src.withColumnRenamed("_id", "doc_id"), "doc_id", "long", channel, scorer, table)
    x = a * F.col("top") + b * F.col("some") + c
    out = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x)))))
    return out.select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
