"""Repair of text read from scanned pages into running paragraphs.

A page's lines are parted into furniture (running headers and footers, page numbers) and body. The body is read
as one stream without line ends and decoded by a joint best-path search: a piece of the stream is a word as it
stands, a word with wrongly recognised characters, a word broken at a line's end, a word parted by a stray
blank, or two words run together. Paragraph boundaries are the cheapest chain of breaks over the lines. Words
and line templates are counted over the whole collection first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: What a scanner reads (left) for what is printed (right). A confusion of two steps costs two.
CONFUSIONS = {
    "c": [("e", 1)], "e": [("c", 1)], "0": [("o", 1), ("a", 2)], "!": [("i", 1)], "1": [("i", 1), ("l", 1)], "|": [("l", 1), ("i", 2)],
    "o": [("a", 1)], "ri": [("n", 1)], "f": [("t", 1)], "cl": [("d", 1)], "5": [("s", 1)], "ii": [("u", 1)], "rn": [("m", 1)],
    "m": [("rn", 1)], "b": [("h", 1)], "q": [("g", 1)], "6": [("b", 1)], "vv": [("w", 1)], "h": [("li", 1)], "ﬁ": [("fi", 1)], "ﬂ": [("fl", 1)],
}
#: What a letter is written as in a word's form. No confusion changes the form, so what a word may be misread from has its form.
FORM = {"c": "e", "0": "a", "o": "a", "!": "i", "1": "i", "|": "i", "l": "i", "n": "ri", "f": "t", "d": "ei", "5": "s", "u": "ii", "m": "rri", "b": "ii", "h": "ii", "6": "ii", "q": "g", "w": "vv", "ﬁ": "ti", "ﬂ": "ti"}
_FORM = str.maketrans(FORM)
_BY_FIRST = {c: [(seen, ways) for seen, ways in CONFUSIONS.items() if seen[0] == c] for c in {s[0] for s in CONFUSIONS}}
HYPHENS = "-­¬‐"
ODD = re.compile(r"[0156!|ﬁﬂ]")
CODE = re.compile(r"[A-Za-z]?[-_]?\d[\d.,]*")
EDGES = "\"'([{<“‘"
TAILS = ".,;:?\"')]}>”’"
#: Pages that make a word sure, and sure enough to stand for a piece two steps away; in a small collection that part of
#: its pages does. One step away any counted word may stand, if the ratio of the two forms' pages allows it.
SURE, SURER = (6, 0.0008), (29, 0.004)
#: Letters that stand for digits in badly read page numbers.
DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8"})
_N = r"[\dlIOoSsB]{1,4}"
_NUMBER = re.compile(rf"\[ ?({_N}) ?\]|[-–] ?({_N}) ?[-–]|p\. ?({_N})|({_N}) ?\||[Pp]age ({_N}) of {_N}|({_N})|([ivxl]+)", re.ASCII)
_TAIL_NUMBER = re.compile(rf"^(.*?\S)(?:\s{{2,}}|\s+/\s+)(?:{_NUMBER.pattern})$", re.ASCII)
_HEAD_NUMBER = re.compile(rf"^(?:{_NUMBER.pattern})\s{{2,}}(\S.*)$", re.ASCII)


_CODES = re.compile(r"\b[A-Za-z]?[-_]?\d[\w.,]*")
_LETTERS = re.compile("[a-z]+")
_PARTS = re.compile(r"[\s\-/:]+")
_LATIN = re.compile("[A-Za-z]")
_GAP = re.compile(r"\s\s|\s/\s")
_LOWER = re.compile(r"[a-z]\S*\s+[a-z]")


def template(line: str) -> str:
    """Letters of a line in lower case, its page number and codes taken off."""
    return " ".join(_LETTERS.findall(_CODES.sub(" ", line).lower()))


def roman(s: str) -> int:
    total, last = 0, 0
    for ch in reversed(s):
        v = {"i": 1, "v": 5, "x": 10, "l": 50}[ch]
        total, last = (total - v, last) if v < last else (total + v, v)
    return total


def page_number(s: str) -> tuple[int | None, bool] | None:
    """(number, decorated) of a line that is a page number and nothing else; None for any other."""
    m = _NUMBER.fullmatch(s)
    if not m:
        return None
    groups = m.groups()
    if groups[6]:
        return roman(groups[6]), False
    text = next(g for g in groups if g)
    if not any(c.isdigit() for c in text) and not groups[0] and not groups[1] and not groups[4]:
        return None
    digits = text.translate(DIGITS)
    return (int(digits) if digits.isdigit() else None), groups[5] is None


def _threes(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 3] for i in range(len(w) - 2)}


def form(word: str) -> str:
    """What is the same in all words that the confusions make of one another."""
    return word.translate(_FORM)


def misread_cost(seen: str, true: str, most: int) -> int | None:
    """The least cost of the confusions that make ``true`` of ``seen``; None above ``most``."""
    costs = {(0, 0): 0}
    for i in range(len(seen) + 1):
        for (a, j), spent in [x for x in costs.items() if x[0][0] == i]:
            if i < len(seen) and j < len(true) and seen[i] == true[j]:
                costs[i + 1, j + 1] = min(spent, costs.get((i + 1, j + 1), 99))
            for length in (1, 2):
                for made, cost in CONFUSIONS.get(seen[i : i + length], ()) if i + length <= len(seen) else ():
                    if spent + cost <= most and true.startswith(made, j):
                        at = (i + length, j + len(made))
                        costs[at] = min(spent + cost, costs.get(at, 99))
    return costs.get((len(seen), len(true)))


class Language:
    """What was counted over the collection: pages of words, of hyphenated words and of edge lines."""

    def __init__(self, words: dict[str, int], templates: dict[str, int], pages: int):
        self.words, self.templates, self.pages = words, templates, max(pages, 1)
        inside = Counter()
        for t in templates:
            inside.update(set(t.split()))
        self.title_words = Kin({w for w, n in inside.items() if n >= 3 and len(w) >= 4})
        self.title_lines = Kin({t.replace(" ", "") for t, n in templates.items() if n >= 8})
        self.same: dict[str, list[str]] = {}
        for w in words:
            self.same.setdefault(form(w), []).append(w)
        self.open: dict[str, Asked] = {}  # what is not whole at hand, by kind
        self.kin: dict[str, bool] = {}
        self.plain: dict[str, float | None] = {}
        self.cores: dict[str, str] = {}
        self.floor = min(1e-7, 7e-4 / self.pages)  # the rate of what is in no page, below that of any known word at any size
        self.memo: dict[str, tuple[str, float]] = {}
        self.heads, self.parts = Counter(), Counter()
        for w, n in words.items():
            if "-" in w:
                self.heads[w.split("-")[0]] += n
                self.parts.update(dict.fromkeys(w.split("-"), n))
        self.shapes: Counter = Counter()
        shapes = Counter(t for w in words if "-" not in w and self.read(w)[0] == w for t in _threes(w))  # of words that are no misreadings
        self.shapes = shapes
        self.memo = {}

    def open_words(self, words: dict[str, int], heads: tuple[dict[str, int], bool], parts: tuple[dict[str, int], bool]) -> None:
        """Takes the most frequent words, and (most frequent, whether there are more) of the parts of hyphenated words."""
        self.open["form"] = self.same = Asked({})
        self.words = Formed(words, self.same)
        if heads[1]:
            self.open["head"] = Asked(heads[0])
        if parts[1]:
            self.open["part"] = Asked(parts[0])
        self.heads, self.parts = self.open.get("head", Counter(heads[0])), self.open.get("part", Counter(parts[0]))

    def open_lines(self, templates: dict[str, int], titles: tuple[dict[str, int], bool], headings: tuple[dict[str, int], bool]) -> None:
        """The same for edge lines, the words of titles and the frequent lines without blanks."""
        self.open["line"] = self.templates = Asked(templates)
        self.title_words, self.title_lines = Kin(set(titles[0])), Kin(set(headings[0]))
        if titles[1]:
            self.open["title"] = self.title_words = Near(self.title_words)
        if headings[1]:
            self.open["heading"] = self.title_lines = Near(self.title_lines)

    def turn(self, found: list[dict] | None) -> None:
        """Takes what was found for the next text, in place of what was found for the last one."""
        for asked in self.open.values():
            asked.found, asked.asked = {}, set()
        for x in found or ():
            at = self.open[x["kind"]].found
            if x["kind"] == "form":
                at.setdefault(form(x["w"]), {})[x["w"]] = x["count"]
            else:
                at[x["w"]] = x["count"]
        for memo in (self.memo, self.plain, self.cores, self.kin):
            memo.clear()

    def wanted(self) -> list[tuple[str, str]]:
        """(kind, string) of what was asked since the last turn and is not known."""
        return [(kind, w) for kind, asked in self.open.items() for w in asked.asked]

    def shape(self, word: str) -> int:
        """In how many words the rarest three letters of ``word`` occur."""
        return min(self.shapes[t] for t in _threes(word))

    def is_kin(self, word: str) -> bool:
        """Whether a word of a line is a title word but for one letter."""
        known = self.kin.get(word)
        if known is None:
            if len(self.kin) > 200_000:
                self.kin.clear()
            known = self.kin[word] = template(word).replace(" ", "") in self.title_words
        return known

    def sure(self, piece: str) -> float | None:
        """The score of a piece that is a word as it stands on any page, whatever stands beside it; else None."""
        if piece in self.plain:
            return self.plain[piece]
        before, core, owner, after = split_piece(piece)
        low, out = core.lower(), None
        self.cores[piece] = low
        if core and "-" not in low and "!" not in core and piece[-1] not in HYPHENS and low in self.words and (len(low) < 4 or CODE.fullmatch(low) or self.enough(low, SURE)):
            word, score = self.read(low)
            out = score if word == low else None
        self.plain[piece] = out
        return out

    def rate(self, word: str) -> float:
        return self.words.get(word, 0) / self.pages

    def enough(self, word: str, least: tuple[int, float]) -> bool:
        """Whether ``word`` is in so many pages, or in so large a part of them where that is less."""
        return self.words.get(word, 0) >= min(least[0], least[1] * self.pages)

    def candidates(self, word: str, most: int) -> dict[str, int]:
        """Words that the confusions make of ``word`` and their least cost, up to ``most``."""
        out: dict[str, int] = {}
        sites = [(i, seen, true, cost) for i, c in enumerate(word) if c in _BY_FIRST for seen, ways in _BY_FIRST[c] if len(seen) == 1 or word.startswith(seen, i) for true, cost in ways]

        def go(start: int, at: int, made: str, spent: int) -> None:
            if spent:
                whole = made + word[start:]
                if spent < out.get(whole, 99):
                    out[whole] = spent
            for k in range(at, len(sites)):
                i, seen, true, cost = sites[k]
                if i >= start and spent + cost <= most:
                    go(i + len(seen), k + 1, made + word[start:i] + true, spent + cost)

        go(0, 0, "", 0)
        return out

    def alike(self, word: str, most: int) -> dict[str, int]:
        """The same of the known words alone, which all have the form of ``word``."""
        out = {}
        for cand in sorted(self.same.get(form(word), ()), key=lambda w: (len(w), w)):
            cost = misread_cost(word, cand, most) if cand != word else None
            if cost:
                out[cand] = cost
        return out

    def read(self, word: str) -> tuple[str, float]:
        """(printed word, log score) for a piece in lower case; the piece itself where nothing better is known."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            known = self.memo[word] = self._read(word)
        return known

    def _read(self, word: str) -> tuple[str, float]:
        own = self.rate(word)
        odd = len(ODD.findall(word))
        if len(word) < 3 or CODE.fullmatch(word) or not re.search(r"[a-z]", word) or own > 0.02:
            return word, log(own + self.floor)
        alone = max(own, self.parts[word] / self.pages)  # a part of hyphenated words is no misreading of another word
        best, score = word, log(own + self.floor)
        for cand, cost in self.alike(word, max(2, odd + 1)).items():
            rate = self.rate(cand)
            if odd:
                value = log(rate) - 3.0 * max(0, cost - odd)
                if best == word or value > score:
                    best, score = cand, value
            elif (cost == 1 or self.enough(cand, SURER)) and rate >= alone * (40 if cost == 1 else 1_000):
                value = log(rate) - 3.6 * cost
                if value > score:
                    best, score = cand, value
            elif cost == 1 and len(word) >= 5 and not own and self.shapes and self.shape(cand) >= max(4, 20 * self.shape(word)):
                value = log(rate) - 3.6  # a rare word, but its letters fit and the piece's don't
                if value > score:
                    best, score = cand, value
        if best != word:  # a misreading that is frequent enough to be counted as a word
            better = self.read(best)[0]
            best = better if better in self.words else best
        return best, score


def furniture(lines: list[str], page_no: int | None, lang: Language) -> list[bool]:
    """Which lines are running headers, footers or page numbers."""
    n = len(lines)
    bare = [x.strip(" \t\r\x0c ") for x in lines]
    full = [i for i in range(n) if bare[i]]
    mark = [False] * n
    if not full:
        return mark
    wide = max(len(b) for b in bare)
    first, last = set(full[:2]), set(full[-3:])
    near = {page_no, page_no + 1} if page_no is not None else None

    def title(s: str, edge: bool) -> bool:
        """Whether a line reads like a running header or footer."""
        gap = _GAP.search(s) is not None
        if not edge and not gap and _LOWER.match(s):  # two words in lower case: no title inside a page begins so
            return False
        m = (_TAIL_NUMBER.match(s) or _HEAD_NUMBER.match(s)) if gap else None
        text = (m.group(1) if m and m.re is _TAIL_NUMBER else m.groups()[-1] if m else s).strip()
        if text[0].isupper() or not text[0].isalpha():
            if not text.endswith((".", ";", "?")):
                letters = template(text)
                if len(letters) >= 5 and lang.templates.get(letters, 0) >= 3:
                    return True
        if text.endswith((".", ";", "?", ",")):
            return False
        words = [w for w in _PARTS.split(text) if _LATIN.search(w)]
        if not words or len(text) > max(70, wide + 10):
            return False
        upper = sum(1 for w in words if w[0].isupper() or not w[0].isalpha())
        if len(words) >= 2 and upper == len(words) and (edge or m is not None):
            return True
        some = len(words) >= 2 and upper >= len(words) - (len(words) >= 4)
        if not some and not edge:
            return False
        kin = sum(lang.is_kin(w) for w in words)
        if some and kin * 2 >= len(words):
            return True
        if edge and kin and kin * 3 >= len(words) * 2 and upper:
            return True
        if edge and text[0].isupper() and re.search(r"\d", text) and "".join(re.findall("[a-z]", re.sub(r"[-_]?\w?\d[\w.]*$", "", text).lower())) in lang.title_lines:
            return True
        return edge and 2 <= len(words) <= 4 and text[0].isupper() and re.fullmatch(r"[A-Z][-_]?\w{2,5}", text.split()[-1]) is not None and len(re.findall(r"\d", text.split()[-1])) >= 2 and kin > 0

    for i in full:
        number = page_number(bare[i])
        edge = i in first or i in last or lines[i].startswith("\x0c")
        if number is not None:
            value, decorated = number
            if near is not None:
                mark[i] = value in near or (decorated and edge) or (decorated and value is not None and min(abs(value - p) for p in near) <= 2)
            else:
                mark[i] = decorated or edge
            if not decorated and not re.search(r"\d", bare[i]) and re.fullmatch("[ivxl]+", bare[i]):
                mark[i] = mark[i] or edge
        else:
            mark[i] = title(bare[i], edge) or (lines[i].startswith("\x0c") and len(bare[i]) < 0.9 * wide and not bare[i].endswith(".") and bare[i][0].isupper() and title(bare[i], True))
    changed = True
    while changed:  # a title-like or numeric line beside furniture inside the text is at a page's turn
        changed = False
        for k, i in enumerate(full):
            if mark[i] or i in first or i in last:
                continue
            beside = (k > 0 and mark[full[k - 1]] and full[k - 1] not in first) or (k + 1 < len(full) and mark[full[k + 1]])
            if beside and page_number(bare[i]) is None and title(bare[i], True):
                mark[i] = changed = True
    return mark


def one_off(a: str, b: str) -> bool:
    """Whether two words are equal but for one letter that is changed, lost or added."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Kin:
    """Whether a word is one of some words but for a letter that is changed, lost or added.

    One letter leaves the first or the second half of a word as it is, so words are found by either half."""

    def __init__(self, words: set[str]):
        self.words = words
        self.halves: dict[tuple[int, str], list[str]] = {}
        for w in words:
            h = len(w) // 2
            self.halves.setdefault((len(w), w[:h]), []).append(w)
            self.halves.setdefault((-len(w), w[h:]), []).append(w)
        self.memo: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        if word in self.words:
            return True
        if len(word) < 4:
            return False
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[word] = self._near(word)
        return known

    def _near(self, word: str) -> bool:
        for n in range(len(word) - 1, len(word) + 2):
            h = n // 2
            for key in ((n, word[:h]), (-n, word[len(word) - (n - h) :])):
                if any(one_off(word, w) for w in self.halves.get(key, ())):
                    return True
        return False


def split_piece(piece: str) -> tuple[str, str, str, str]:
    """(before, core, possessive, after) of a piece of the stream."""
    a, b = 0, len(piece)
    while a < b and piece[a] in EDGES:
        a += 1
    while b > a and piece[b - 1] in TAILS:
        b -= 1
    core, owner = piece[a:b], ""
    if core[-2:] in ("'s", "’s"):
        core, owner = core[:-2], core[-2:]
    return piece[:a], core, owner, piece[b:]


def like(word: str, as_: str) -> str:
    """``word`` in the letter case of ``as_``."""
    letters = [c for c in as_ if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if as_[:1].isupper() else word


def judge(core: str, lang: Language, page: Counter) -> tuple[str, bool, float]:
    """(word, misread, score) of a core as one word."""
    low = core.lower()
    if "-" in low and low not in lang.words:
        parts = [judge(p, lang, page) for p in low.split("-")]
        if all(parts) and any(m for _, m, _ in parts):
            return "-".join(w for w, _, _ in parts), True, min(s for _, _, s in parts)
        return low, False, -16.0
    word, score = lang.read(low)
    if word != low and (ODD.search(low) or page[low] < 2 or page[word] > page[low] or lang.enough(word, SURER)):
        return word, True, score
    if len(low) >= 4 and not CODE.fullmatch(low) and not lang.enough(low, SURE):
        odd = len(ODD.findall(low))
        here = [(page[c], -cost, c) for c, cost in lang.candidates(low, 2 + (odd > 1)).items() if page[c] > page[low] or (odd and page[c])]
        if here:
            return max(here)[2], True, -9.0
        if odd and re.search(r"[a-z]", low) and len(re.findall(r"[a-zﬁﬂ]", low)) * 3 >= len(low) * 2 and not re.fullmatch(r"[a-z]+\d", low.replace("1", "l").replace("0", "o").replace("5", "s")) and not re.search(r"\d{2,}$", low):
            plain = low.replace("0", "o").replace("1", "l").replace("!", "i").replace("|", "l").replace("5", "s").replace("6", "b").replace("ﬁ", "fi").replace("ﬂ", "fl")
            if plain.isalpha():
                return plain, True, -15.0
    return low, False, score


def decode(lines: list[str], skip: list[bool], lang: Language) -> tuple[list[tuple[int, str]], set[tuple[int, str]]]:
    """The words of the body as (line, text), and the (line, kind) found on the way."""
    pieces: list[tuple[int, str, bool]] = []  # line, piece, last of its line
    for i, line in enumerate(lines):
        if not skip[i]:
            got = line.replace("\x0c", " ").split()
            pieces += [(i, p, k == len(got) - 1) for k, p in enumerate(got)]
    n = len(pieces)
    if len(lang.plain) > 400_000:
        lang.plain.clear()
        lang.cores.clear()
    sure = [lang.sure(p) for _, p, _ in pieces]
    page = Counter(lang.cores[p] for _, p, _ in pieces) if None in sure else Counter()
    score = [0.0] + [float("-inf")] * n
    back: list[tuple] = [()] * (n + 1)

    def offer(a: int, b: int, value: float, text: str, kinds: list[tuple[int, str]]) -> None:
        if score[a] + value > score[b]:
            score[b] = score[a] + value
            back[b] = (a, text, kinds)

    for k in range(n):
        if score[k] == float("-inf"):
            continue
        line, piece, ends = pieces[k]
        if sure[k] is not None:
            if score[k] + sure[k] > score[k + 1]:
                score[k + 1] = score[k] + sure[k]
                back[k + 1] = (k, piece, ())
            continue
        before, core, owner, after = split_piece(piece)
        if ends and len(piece) > 1 and piece[-1] in HYPHENS and (piece[-2].isalnum() or piece[-2] in "!|'"):
            head = piece[len(before) : -1]
            stem = head.split("-")[-1]
            if k + 1 < n:
                rest_line, rest, _ = pieces[k + 1]
                _, rest_core, rest_owner, rest_after = split_piece(rest)
                joined = judge(head + rest_core, lang, page)
                compound = (head + "-" + rest_core).lower()
                coded = len(stem) <= 1 or re.fullmatch(r"\W*[\d]+.*", rest_core) is not None
                dashed = piece[-1] == "-" and (lang.words.get(compound, 0) > 0 and lang.words.get(compound, 0) * 8 >= lang.words.get((head + rest_core).lower(), 0))
                if piece[-1] == "-" and not dashed and compound not in lang.words and (head + rest_core).lower() not in lang.words:
                    read = judge(compound, lang, page)[0]
                    dashed = read != compound and read in lang.words
                    compound = read if dashed else compound
                if coded or dashed:
                    kinds = []
                    for at, part in ((line, head), (rest_line, rest_core)):
                        if not coded and judge(part, lang, page)[1]:
                            kinds.append((at, "misread"))
                    offer(k, k + 2, -6.0, before + like(compound if not coded else head + "-" + rest_core, head) + rest_owner + rest_after, kinds)
                else:
                    word, misread, value = joined
                    kinds = [(line, "hyphen")]
                    if misread:
                        seen, at = (head + rest_core).lower(), len(head)
                        pre = 0
                        while pre < min(len(seen), len(word)) and seen[pre] == word[pre]:
                            pre += 1
                        post = 0
                        while post < min(len(seen), len(word)) - pre and seen[-1 - post] == word[-1 - post]:
                            post += 1
                        if pre < at:
                            kinds.append((line, "misread"))
                        if len(seen) - post > at:
                            kinds.append((rest_line, "misread"))
                    offer(k, k + 2, value, before + like(word, head) + rest_owner + rest_after, kinds)
                continue
            if len(stem) > 1 and (piece[-1] != "-" or lang.heads[stem.lower()] < 0.5 * lang.words.get(stem.lower(), 0) + 1):
                kinds = [(line, "hyphen")]
                offer(k, k + 1, -10.0, piece, kinds)
            else:
                offer(k, k + 1, -10.0, piece, [])
            continue
        if core.endswith("!") and core[:-1].lower() in lang.words and core[:-1].lower() + "i" not in lang.words:
            core, after = core[:-1], "!" + after
        word, misread, value = judge(core, lang, page) if core else ("", False, -1.0)
        offer(k, k + 1, value, before + (like(word, core) if word != core.lower() else core) + owner + after, [(line, "misread")] if misread else [])
        if not misread and core.isalpha() and core.lower() not in lang.words and len(core) >= 2:
            if k + 1 < n and not ends and not after and pieces[k + 1][0] == line:  # a word parted by a blank
                _, core2, owner2, after2 = split_piece(pieces[k + 1][1])
                both = (core + core2).lower()
                if core2.isalpha() and core2.lower() not in lang.words and both in lang.words:
                    offer(k, k + 2, log(lang.rate(both)) - 2.0, before + like(both, core) + owner2 + after2, [])
            if len(core) >= 6:  # two words run together
                low = core.lower()
                cuts = [(log(lang.rate(low[:c])) + log(lang.rate(low[c:])) - 2.0, c) for c in range(2, len(low) - 1) if lang.rate(low[:c]) >= 0.01 and lang.rate(low[c:]) >= 0.01]
                if cuts and max(cuts)[0] > value:
                    cut = max(cuts)
                    offer(k, k + 1, cut[0], before + core[: cut[1]] + " " + core[cut[1] :] + owner + after, [])
    words: list[tuple[int, str]] = []
    found: set[tuple[int, str]] = set()
    k = n
    while k:
        a, text, kinds = back[k]
        words.append((pieces[a][0], text))
        found.update(kinds)
        k = a
    return words[::-1], found


def paragraphs(lines: list[str], skip: list[bool], words: list[tuple[int, str]]) -> list[str]:
    """The words in paragraphs: the cheapest chain of breaks between body lines, where a break costs by what is
    seen there (blank line, indent, short full-stopped line before) and a paragraph by its number of lines."""
    body = [i for i in range(len(lines)) if not skip[i] and lines[i].strip()]
    if not body:
        return []
    wide = max(len(lines[i].strip()) for i in body)
    cost = [0.0]
    for p, i in zip(body, body[1:]):
        blank = any(not lines[j].strip() for j in range(p + 1, i) if not skip[j]) and not any(skip[p + 1 : i])
        stop = lines[p].rstrip().endswith((".", "?", "!", ":", ";"))
        indent = lines[i][:2] == "  " or lines[i][:1] == "\t"
        c = 3.0 - 4.0 * blank - 3.0 * indent - 1.5 * (stop and len(lines[p].strip()) < 0.7 * wide) + (2.0 if not stop else 0.0) + (1.5 if lines[i].lstrip()[:1].islower() else 0.0)
        cost.append(c)
    m = len(body)
    best, back, begun = [0.0] * (m + 1), [0] * (m + 1), [0.0] * m
    long = (float("inf"), 0)  # the best start of a paragraph of more than 12 lines, less what its length costs
    for end in range(1, m + 1):
        begun[end - 1] = best[end - 1] + (cost[end - 1] if end > 1 else 0.0)
        options = [(begun[end - 1] + 0.5, end - 1)]
        if end > 1:
            near = begun[max(0, end - 12) : end - 1]
            low = min(near)
            options.append((low, max(0, end - 12) + near.index(low)))
        if end > 12:
            start = end - 13
            long = min(long, (begun[start] - 0.01 * (start + 12), start))
            options.append((long[0] + 0.01 * end, long[1]))
        best[end], back[end] = min(options)
    starts, k = [], m
    while k:
        k = back[k]
        starts.append(body[k])
    starts = sorted(starts)
    out, at, current = [], 0, []
    for line, text in words:
        while at + 1 < len(starts) and line >= starts[at + 1]:
            at += 1
            if current:
                out.append(" ".join(current))
                current = []
        current.append(text)
    return [*out, " ".join(current)] if current else out


def repair(text: str | None, page_no: int | None, lang: Language) -> tuple[str, list[tuple[int, str]]]:
    """(running text, [(line number, kind)]) of one page or two following ones."""
    lines = (text or "").split("\n")
    skip = furniture(lines, page_no, lang)
    words, found = decode(lines, skip, lang)
    marks = sorted({(i + 1, "furniture") for i in range(len(lines)) if skip[i]} | {(i + 1, k) for i, k in found})
    return "\n\n".join(paragraphs(lines, skip, words)), marks


class Asked:
    """What was counted of strings, of which the most frequent are at hand; what is asked of others is noted, and answered by what
    was found for the page."""

    def __init__(self, held: dict[str, int]):
        self.held, self.found, self.asked = held, {}, set()

    def get(self, text: str, default=0):
        n = self.held.get(text) or self.found.get(text)
        if n is None:
            self.asked.add(text)
            return default
        return n

    def __getitem__(self, text: str) -> int:
        return self.get(text)

    def __contains__(self, text: str) -> bool:
        return self.get(text) > 0


class Formed(Asked):
    """Counts of words; of a word that is not at hand the form is asked, and all words of that form are found together."""

    def __init__(self, held: dict[str, int], same: Asked):
        super().__init__(held)
        self.same = same

    def get(self, text: str, default=0):
        return self.held.get(text) or (self.same.get(form(text), None) or {}).get(text, default)


class Near(Asked):
    """``Kin`` of which the most frequent words are at hand."""

    def __init__(self, kin: Kin):
        super().__init__({})
        self.kin = kin

    def __contains__(self, text: str) -> bool:
        return text in self.kin or super().__contains__(text)


def counted(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(w, count) of all words and of all edge-line templates in at least ``least`` pages."""
    # what ends a line may be part of a broken word, so it is no evidence for a word
    clean = F.regexp_replace("text", "[A-Za-z]+[-­¬‐][ \\r]*\\n\\s*[A-Za-z]*", " ")
    words = pages.select(clean.alias("t")).select(F.explode(F.array_distinct(F.transform(F.expr("regexp_extract_all(t, '([A-Za-z]+(?:-[A-Za-z]+)*)', 1)"), lambda x: F.lower(x)))).alias("w"))
    lines = F.filter(F.split(F.regexp_replace("text", "[\\r\\x0c]", ""), "\n"), lambda x: F.trim(x) != "")
    n = F.size("l")
    edge = pages.select(lines.alias("l")).select(F.explode(F.array_distinct(F.concat(F.slice("l", 1, 2), F.slice("l", F.greatest(n - 2, F.lit(1)), F.lit(3))))).alias("x"))
    letters = F.regexp_replace(F.lower(F.regexp_replace("x", "\\b[A-Za-z]?[-_]?\\d[\\w.,]*", " ")), "[^a-z]+", " ")
    edge = edge.filter("not trim(x) rlike '[.;?,]$'").select(F.trim(F.regexp_replace(letters, " [ivxlp]+ *$|^ *[ivxlp]+ ", " ")).alias("w")).filter("length(w) >= 5")
    return tuple(written(x.groupBy("w").count().filter(F.col("count") >= least), "scan-counts") for x in (words, edge))


def _most(counts: DataFrame, most: int) -> tuple[dict[str, int], bool]:
    """The ``most`` most frequent strings, and whether there are more."""
    t = counts.orderBy(F.desc("count"), "w").limit(most + 1).toArrow()
    rows = dict(zip(t.column(0).to_pylist()[:most], t.column(1).to_pylist()[:most]))
    return rows, t.num_rows > most


def _parts(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, count) of the first parts and of all parts of hyphenated words, by pages of these words."""
    split = words.filter("w like '%-%'").select(F.split("w", "-").alias("p"), "count")
    heads = split.select(F.col("p")[0].alias("w"), "count")
    parts = split.select(F.explode(F.array_distinct("p")).alias("w"), "count")
    return tuple(written(x.groupBy("w").agg(F.sum("count").alias("count")), "scan-parts") for x in (heads, parts))


def _titles(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, count) of the words of titles, by templates, and of the frequent templates without blanks."""
    inside = lines.select(F.explode(F.array_distinct(F.split("w", " "))).alias("w")).filter("length(w) >= 4").groupBy("w").count().filter("count >= 3")
    headings = lines.filter("count >= 8").select(F.expr("replace(w, ' ', '')").alias("w"), "count").groupBy("w").agg(F.sum("count").alias("count"))
    return written(inside, "scan-titles"), written(headings, "scan-titles")


def _formed(words: DataFrame) -> DataFrame:
    """(kind, w, word, count) of all words by their form."""
    made = F.col("w")
    for letter, becomes in FORM.items():  # no letter becomes one that becomes another
        if letter.isalpha() and letter.isascii():
            made = F.replace(made, F.lit(letter), F.lit(becomes))
    return words.select(F.lit("form").alias("kind"), made.alias("w"), F.col("w").alias("word"), "count")


def _of_kind(kind: str, counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(kind).alias("kind"), "w", F.col("w").alias("word"), "count")


def keyed(strings: DataFrame) -> DataFrame:
    """``strings`` (kind, w) with a hash ``key``: of the string; of a title word or line, which is looked for but for one letter, of all
    that is left without one letter and of the whole. Two that differ by one letter at most have a key in common."""
    less = "array_distinct(transform(sequence(0, length(w)), i -> xxhash64(concat(left(w, i), substring(w, i + 2)))))"
    return strings.withColumn("key", F.explode(F.expr(f"CASE WHEN kind IN ('title', 'heading') THEN {less} ELSE array(xxhash64(w)) END")))


FOUND = "array<struct<kind:string,w:string,count:long>>"


def settled(rows: DataFrame, ask, every: DataFrame) -> DataFrame:
    """``rows`` with an array ``found`` of all that ``ask`` wants to know from ``every`` (kind, w, word, count, key): words of a form,
    counts of a string, title words and lines that are one but for one letter. Only rows for which something was found ask again."""
    full = every.select("kind", "key", F.col("w").alias("to"), "word", "count")
    same = F.expr("CASE WHEN kind IN ('title', 'heading') THEN w = to OR (length(w) >= 4 AND levenshtein(w, to) <= 1) ELSE w = to END")
    todo, known, turn = rows.withColumn("found", F.lit(None).cast(FOUND)), None, 0
    out = todo
    while True:
        asked = keyed(todo.select("doc_id", "text", "page_no", "found").mapInArrow(ask, "doc_id long, kind string, w string"))
        hits = asked.join(full, ["kind", "key"]).filter(same)
        new = written(hits.select("doc_id", "kind", F.expr("CASE WHEN kind = 'form' THEN word ELSE w END").alias("w"), "count", F.lit(turn).alias("turn")), "scan-found")
        if not new.head(1):
            return out
        known = new if known is None else known.unionByName(new)
        each = known.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "w", "count")).alias("found"), F.max("turn").alias("last"))  # at most what one page asks for
        out = rows.join(each, "doc_id", "left")
        todo = out.filter(F.col("last") == turn)
        turn += 1


def scan_repair(corpus: DataFrame, most_words: int = 300_000, most_templates: int = 200_000, least: int = 3) -> DataFrame:
    """(doc_id, text, marks) of every page with a text: running text, paragraphs parted by an empty line, and
    an array of (line_no, kind), lines counted from 1 and parted by line feeds.

    ``kind`` is 'furniture', 'hyphen' or 'misread'. A repeated row counts once; of rows of one doc_id that
    differ, the largest text stands, with the smallest page_no. Null doc_ids and texts have no row; empty
    and blank texts give an empty text without marks; a null page_no leaves the form and place of a number to
    decide. A table or a list keeps its lines within its paragraph.

    Words and edge lines are counted over all pages. The ``most_words`` and ``most_templates`` most frequent go to the tasks.
    Where there are more, pages are first read to see what else they ask for (words by form, lines, parts of hyphenated words,
    kin of title words and lines), which is joined with the full tables and handed to the page, until nothing more is found.
    Letter shapes, of which there are no more than letters allow, are counted from all words in the same way: the result is
    that of the full tables at any size.
    """
    spark = corpus.sparkSession
    pages = written(corpus.filter("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max("text").alias("text"), F.min("page_no").cast("int").alias("page_no")), "scan-pages")
    tables = counted(pages, least)
    (words, more_words), (lines, more_lines) = _most(tables[0], most_words), _most(tables[1], most_templates)
    lang = Language({} if more_words else words, {} if more_lines else lines, pages.count())
    every = []
    if more_words:
        heads, parts = _parts(tables[0])
        lang.open_words(words, _most(heads, most_words), _most(parts, most_words))
        every += [_formed(tables[0]), _of_kind("head", heads), _of_kind("part", parts)]
    if more_lines:
        titles, headings = _titles(tables[1])
        lang.open_lines(lines, _most(titles, most_templates), _most(headings, most_templates))
        every += [_of_kind("line", tables[1]), _of_kind("title", titles), _of_kind("heading", headings)]
    every = keyed(reduce(DataFrame.unionByName, every)) if every else None
    rows = pages.withColumn("found", F.lit(None).cast(FOUND))

    def asking(held, work):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lang = held.value
            for b in batches:
                for s in range(0, b.num_rows, 200):
                    got = []
                    for d, text, number, found in zip(*(c.to_pylist() for c in b.slice(s, 200).columns)):
                        lang.turn(found)
                        work(text, number, lang)
                        got += [(d, k, w) for k, w in lang.wanted()]
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "kind", "w"])

        return ask

    if more_words:  # shapes of the words that are no misreadings, read in blocks as if each were a page
        some = spark.sparkContext.broadcast(lang)  # bounded by most_words and most_templates

        def read_all(text: str, number: None, lang: Language) -> list[str]:
            return [w for w in text.split(" ") if lang.read(w)[0] == w]

        def threes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lang, counts = some.value, Counter()
            for b in batches:
                for text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    lang.turn(found)
                    counts.update(t for w in read_all(text, None, lang) for t in _threes(w))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

        single = tables[0].filter("w not like '%-%'")
        blocks = single.groupBy(F.expr(f"pmod(xxhash64(w), {single.count() // 1_000 + 1})").alias("doc_id")).agg(F.array_join(F.collect_list("w"), " ").alias("text"), F.lit(None).cast("int").alias("page_no"))
        got = settled(written(blocks, "scan-blocks"), asking(some, read_all), every).select("text", "found").mapInArrow(threes, "t string, n long")
        shapes = got.groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # three letters or edges: below 30 cubed
        lang.shapes = Counter(dict(zip(shapes.column(0).to_pylist(), shapes.column(1).to_pylist())))
    held = spark.sparkContext.broadcast(lang)  # bounded by most_words and most_templates
    if lang.open:
        rows = settled(pages, asking(held, repair), every)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, lang = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())])), held.value
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part, got = b.slice(s, 500), []
                for text, number, found in zip(*(c.to_pylist() for c in part.columns[1:])):
                    if lang.open:
                        lang.turn(found)
                    got.append(repair(text, number, lang))
                marks = [[{"line_no": n, "kind": k} for n, k in found] for _, found in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(marks, kind)], ["doc_id", "text", "marks"])

    return rows.select("doc_id", "text", "page_no", "found").mapInArrow(of, "doc_id long, text string, marks array<struct<line_no:int,kind:string>>")


def marked_lines(repaired: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of all marks."""
    return repaired.select("doc_id", F.explode("marks").alias("m")).select("doc_id", F.col("m.line_no").alias("line_no"), F.col("m.kind").alias("kind"))
