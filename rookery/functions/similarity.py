"""Name similarity and cleaning, which Spark has no functions for: Arrow UDFs over distinct names or indexed pairs."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

words = lambda text: frozenset(text.split())

#: Words that names are judged and written by.
TITLES = words("gm im fm cm nm wgm wim wfm wcm mr mrs ms miss dr prof professor coach")
PARTICLES = words("al ap bin bint da das de del dela della der di dos du el la le st ten ter van von")
SHORT = words("ai al an bo da de do du fu gu he hu im jo ju ko le li lu ma md mi mo ng ni om or qi sa so to tu vo wu xu ya yi yu")
NUMERALS = words("ii iii iv vi vii viii ix x")
ANYWHERE = words("account anonymous authorized chess deleted facebook guest instagram official private settings speedrun stream tactics tiktok twitch twitter unknown youtube")
WHOLE = words("anonymous chess none nobody null player private someone unknown")
JOKES = words("animal attack bobred captain chucky coachren dracula fantomas general goatplayer hedgehog krypton lamassu mirage number9 powder rockula shadow shuqamuna skibidi snoopy sonic spider spot tarzan thecrusher undercover victory witchboy")
BAD = words("alligator anonymous bye chess clash daily executioner grandmaster hi incognito item me mister naming no one patriot player russian title tv unknown you yt")
BAD_PAIRS = frozenset({"actually, inform", "doopy, snoopy", "general of, krypton", "man, spider", "player, chess", "sonic the, hedgehog", "winner, aggressive"})
BAD_ANYWHERE = re.compile(r"\b(id|elo|expert|fearsome|hungry|gonna|crush|detective|cloaked|greatest|ultrabullet|barking|madman|slayer|god bless|no title|you know|thinking about|expert on|dark of)\b")

#: The writing of Arabic and Hebrew in Latin letters.
ARABIC = dict(x.split("=") for x in "ا=a أ=a إ=i آ=a ب=b ة=a ت=t ث=th ج=j ح=h خ=kh د=d ذ=dh ر=r ز=z س=s ش=sh ص=s ض=d ط=t ظ=z ع=a غ=gh ف=f ق=q ك=k ل=l م=m ن=n ه=h و=w ؤ=u ي=y ى=a ئ=i ء= پ=p چ=ch ژ=zh گ=g ک=k ی=y ۀ=e ﻻ=la".split())
HEBREW = dict(x.split("=") for x in "א=a ב=b ג=g ד=d ה=h ו=v ז=z ח=h ט=t י=y כ=k ך=k ל=l מ=m ם=m נ=n ן=n ס=s ע=a פ=p ף=p צ=ts ץ=ts ק=k ר=r ש=sh ת=t".split())
#: Latin letters that do not decompose.
LATIN = dict(x.split("=") for x in "ł=l Ł=L ø=o Ø=O đ=d Đ=D ð=d Ð=D ħ=h Ħ=H ŧ=t Ŧ=T ı=i ß=ss ẞ=SS æ=ae Æ=Ae œ=oe Œ=Oe þ=th Þ=Th".split())
IN_LATIN = str.maketrans(ARABIC | HEBREW | LATIN)

NOISE = re.compile(r"https?://|www\.|\.com|(^|[\s(])@[a-z0-9_]|\d|(.)\2{4}|[?;:<>{}\[\]|~*=+\U00010000-\U0010ffff]", re.I)
WRITTEN = str.maketrans({**dict.fromkeys("\u200b\u200c\u200d\u2060"), "、": ",", ";": ",", "“": '"', "”": '"', "’": "'", "‘": "'", "_": " "})


CELLS = 1 << 22


def _letters(x: list[str]) -> np.ndarray:
    """Code points in rows, 0 where a string has ended."""
    rows = np.array(x, dtype=np.str_)
    return rows.view(np.uint32).reshape(len(x), -1) if rows.itemsize else np.zeros((len(x), 0), np.uint32)


def _jaro_winkler(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, m = np.count_nonzero(a, axis=1), np.count_nonzero(b, axis=1)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    place, rows = np.arange(b.shape[1])[None, :], np.arange(len(a))
    mine, theirs = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i in range(a.shape[1]):
        free = (b == a[:, i : i + 1]) & (a[:, i : i + 1] != 0) & ~theirs & (np.abs(place - i) <= reach)
        met = free.any(axis=1)
        mine[:, i] = met
        theirs[rows[met], free.argmax(axis=1)[met]] = True
    k = mine.sum(axis=1)
    first = lambda x, used: np.take_along_axis(x, np.argsort(~used, axis=1, kind="stable"), axis=1)
    width = min(a.shape[1], b.shape[1])
    moved = ((first(a, mine)[:, :width] != first(b, theirs)[:, :width]) & (np.arange(width)[None, :] < k[:, None])).sum(axis=1)
    jaro = (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - moved / 2) / np.maximum(k, 1)) / 3
    same = (a[:, :width] == b[:, :width])[:, :4] & (a[:, : min(4, width)] != 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(k > 0, jaro + prefix * 0.1 * (1 - jaro), np.where((n == 0) & (m == 0), 1.0, 0.0))


def jaro_winkler_of(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarities of pairs, all pairs of a step at once: characters of the first in turn take the first
    free equal one of the second within reach; common prefix up to 4, scale 0.1. Pairs go by length, so that those of
    one step are of like widths and take at most ``CELLS`` places unless one pair has more."""
    lengths = np.array([max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], np.int64)
    order, out, at = np.argsort(lengths, kind="stable"), np.empty(len(lengths)), 0
    while at < len(order):
        room = lengths[order[at:]] * np.arange(1, len(order) - at + 1)
        some = order[at : at + max(1, int(np.searchsorted(room, CELLS, side="right")))]
        out[some] = _jaro_winkler(_letters([a[k] for k in some]), _letters([b[k] for k in some]))
        at += len(some)
    return out


class Strings:
    """Strings whose pairs are to be compared: their letters as numbers, a bit for each of their letters (``sign``, a
    letter's second and later places apart) and how many letters have fallen on others' bits (``spare``). Of strings of
    more than ``MOST`` characters only the length is known, and they count as sharing anything."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(x) for x in texts], np.int64)
        rows = _letters([x if len(x) <= MOST else "" for x in texts])
        there = rows != 0
        self.alphabet, codes = np.unique(rows[there], return_inverse=True)
        self.codes = np.full(rows.shape, len(self.alphabet), np.int64)
        self.codes[there] = codes
        own, place = np.sort(self.codes, axis=1), np.arange(rows.shape[1])
        again = np.zeros(own.shape, bool)
        again[:, 1:] = own[:, 1:] == own[:, :-1]
        turn = place - np.maximum.accumulate(np.where(again, 0, place), axis=1)
        bits = np.where(own < len(self.alphabet), np.uint64(1) << ((own + 29 * turn) % 64).astype(np.uint64), np.uint64(0))
        self.sign = np.bitwise_or.reduce(bits, axis=1)
        self.spare = np.where(self.length > MOST, 128, self.length - np.bitwise_count(self.sign)).astype(np.uint8)
        self._places = None

    def places(self) -> np.ndarray:
        """For each string and letter, the set of its places."""
        if self._places is None:
            self._places, rows = np.zeros((len(self.texts), len(self.alphabet) + 1), np.uint64), np.arange(len(self.texts))
            for j in range(self.codes.shape[1]):
                self._places[rows, self.codes[:, j]] |= np.uint64(1 << j)
            self._places[:, -1] = 0
        return self._places

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs, up to 4 characters."""
        out, on = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for j in range(min(4, self.codes.shape[1])):
            on &= (self.codes[a, j] == self.codes[b, j]) & (self.codes[a, j] < len(self.alphabet))
            out += on
        return out


#: Strings up to so long are compared as sets of places; so are those of an alphabet up to ``LETTERS``.
MOST, LETTERS = 64, 512


def jaro_winkler_reaching(x: Strings, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of places in ``x`` those whose Jaro-Winkler similarity reaches ``least``, and these similarities: as
    ``jaro_winkler_of``, with sets of places for arrays of letters."""
    other = (x.length[a] > MOST) | (x.length[b] > MOST) | (len(x.alphabet) > LETTERS)
    if other.any():
        own = jaro_winkler_of([x.texts[k] for k in a[other]], [x.texts[k] for k in b[other]])
        rest = jaro_winkler_reaching(x, a[~other], b[~other], least) if not other.all() else None
        found = a[other][own >= least], b[other][own >= least], own[own >= least]
        return found if rest is None else tuple(np.concatenate(both) for both in zip(found, rest, strict=True))
    one, places = np.uint64(1), x.places()
    n, m = x.length[a], x.length[b]
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    mine, theirs = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for i in range(int(n.max(initial=0))):
        low = (one << np.maximum(i - reach, 0).astype(np.uint64)) - one
        high = (np.uint64(2) << np.minimum(i + reach, 63).astype(np.uint64)) - one
        free = places[b, x.codes[a, i]] & high & ~low & ~theirs
        theirs |= free & (~free + one)
        mine |= (free != 0).astype(np.uint64) << np.uint64(i)
    k, prefix = np.bitwise_count(mine).astype(np.int64), x.prefix(a, b)

    def scored(k: np.ndarray, n: np.ndarray, m: np.ndarray, moved: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        jaro = (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - moved / 2) / np.maximum(k, 1)) / 3
        return np.where(k > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)

    able = np.flatnonzero(scored(k, n, m, np.zeros(len(a)), prefix) >= least)
    a, b, n, m, k, prefix, mine, theirs = (v[able] for v in (a, b, n, m, k, prefix, mine, theirs))
    moved = np.zeros(len(a), np.int64)
    for j in range(int(k.max(initial=0))):
        at, to = (np.bitwise_count((v & (~v + one)) - one).astype(np.int64) % 64 for v in (mine, theirs))
        width = x.codes.shape[1] - 1
        moved += (j < k) & (x.codes[a, np.minimum(at, width)] != x.codes[b, np.minimum(to, width)])
        mine, theirs = mine & (mine - one), theirs & (theirs - one)
    out = scored(k, n, m, moved, prefix)
    good = out >= least
    return a[good], b[good], out[good]


def jaro_winkler(a: Column, b: Column) -> Column:
    """The same over columns; null counts as empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_of(x.fillna("").tolist(), y.fillna("").tolist()))

    return run(a, b)


def _part(text: str, given: bool) -> str:
    """A last or given name in Latin letters, without wrappers, marks, titles at its ends and, if given, initials."""
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ", text).translate(IN_LATIN)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    text = unicodedata.normalize("NFC", text).replace("`", "").replace('"', "")
    own = re.sub(r"[^\w .'-]|[_\d]", " ", text).split()
    bare = [w.rstrip(".") for w in own]
    keep = [k for k, w in enumerate(bare) if w.lower() not in TITLES]
    if not keep:
        return ""
    inner = range(keep[0], keep[-1] + 1)
    if given and len(inner) > 1 and any(len(bare[k]) > 1 for k in inner):
        inner = [k for k in inner if not (len(bare[k]) == 1 and bare[k].isalpha())]
    return " ".join(own[k] for k in inner).strip(" .,'-")


def _is_initial(word: str) -> bool:
    return len(word) == 1 and word.isupper() or len(word) in (2, 3) and word.isalpha() and word.isupper() and not set(word) & set("AEIOUY")


def _written(word: str, first: bool, given: bool) -> str:
    """A word in ordinary writing."""
    low, capitals = word.lower(), word.isalpha() and word.isupper()
    if low in NUMERALS:
        return low.upper()
    if not given and not first and low in PARTICLES:
        return low
    if capitals and (len(word) == 1 or len(word) < 4 and low not in SHORT and (not given or not set(low) & set("aeiouy"))):
        return word
    cap = lambda x: "Mc" + x[2:].capitalize() if re.fullmatch("mc[a-z]+", x) else x[:1].upper() + x[1:]
    return "".join(map(cap, re.split("([-'])", low)))


def clean_name_of(raw: str | None) -> str | None:
    """A real name as "Last, First", or None where the text is hardly one: links, digits, symbols, words that no name has,
    one word alone, initials only, or a script that has no writing in Latin letters here (Han characters among them)."""
    text = " ".join(unicodedata.normalize("NFKC", html.unescape(raw or "")).translate(WRITTEN).split())
    low = text.lower()
    if NOISE.search(text) or any(w in low for w in ANYWHERE) or not any(c.isalpha() for c in text) or any(unicodedata.category(c) in ("So", "Co", "Cs") for c in text):
        return None
    parts = [p for p in (p.strip() for p in text.split(",")) if p] if "," in text else [text.rpartition(" ")[2], text.rpartition(" ")[0]]
    if len(parts) < 2 or not parts[1]:
        return None
    last, first = _part(parts[0], False), _part(" ".join(parts[1:]), True)
    if not all(re.fullmatch(r"[A-Za-z .'-]+", p) for p in (last, first)):
        return None
    both = [last.lower(), first.lower()]
    whole = ", ".join(both)
    tokens = {w for p in both for w in p.split(" ")}
    if WHOLE & set(both) or tokens & (JOKES | BAD) or whole in BAD_PAIRS or BAD_ANYWHERE.search(whole):
        return None
    if both[0] == both[1] and len(both[0]) < 4 or all(len(p) <= 2 and p.isalpha() for p in both) or all(len(p) == 1 for p in both):
        return None
    if all(_is_initial(w) for p in (last, first) for w in p.split()):
        return None
    return ", ".join(" ".join(_written(w, k == 0, given) for k, w in enumerate(p.split())) for p, given in ((last, False), (first, True)))


def clean_name(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(clean_name_of)

    return run(c)
