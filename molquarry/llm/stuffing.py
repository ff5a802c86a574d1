"""Keyword-stuffed and link-list pages (problem 7).

Two measures are combined, and a character counts only if both speak for it.

*Clause structure.*  A page is cut into segments (sentences and lines).  A
segment lacks clause structure if it has too few function words, or if its
content words are ones the page is stuffed with.  Lines of dialogue, settings,
notation and numbers are data and never count.

*Repetition.*  A suffix automaton of the whole page's tokens gives its maximal
repeated substrings.  One that occurs ``LEAST_TIMES`` times, holds
``LEAST_LETTERS`` letters and takes ``LEAST_DENSITY`` of the page with all its
occurrences covers its characters.  An item (what stands between separators)
of which ``ITEM_SHARE`` is covered is a keyword or slogan as a whole.  Links,
tags and price entries count by what they are, as do entries of a list: items
of one shape in a row.

A page is stuffed when the covered characters of its clauseless segments are
more than half of all its characters.  Prose in a language without listed
function words lacks clause structure by the first measure, but does not repeat
itself, so the second keeps it; release notes and logs repeat themselves, but
have clauses or are data.

Tokens are words, links, tags, numbers and marks; a word glued of two words of
the page is both, a character of a script without blanks is a token of its own.  Words stand for themselves in lower
case, links, tags and numbers for their kind.

Scale: one pass over the documents, no shuffle; cost grows with each page's
length, linear for the automaton.  A page whose clauseless characters are not
more than half cannot be stuffed, so ``stuffed_pages`` builds no automaton for it.

Defined results: null and blank texts are no pages; ties (exactly half) are not
stuffed; repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import ne

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import python_map

# Function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    # English
    "a an the and or but nor so if than then that this these those there here of to in on at by for from with without into over under "
    "between before after during about as is are was were be been being am do does did has have had can could will would shall should "
    "may might must not no it its he she they them their we us our you your i my me his her who which what when where why how all each "
    "every any some such only also too very more most much less both either out up down again once until while because though "
    # German
    "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden wurde hat "
    "haben hatte hatten sich wir sie er es ich ihr im am zum zur von vom mit nach bei bis aus auf für an zu in als auch noch nur schon "
    "dass weil wenn wie wer was dazu doch jedoch beide durch gegen ohne um über unter zwischen "
    # French
    "le la les l un une des du de d c j m t et ou mais ne pas n que qui quoi dont où ce cette ces cet il elle ils elles on nous vous je se s son "
    "sa ses leur leurs est sont était étaient a ont avait avaient sur sous dans par pour avec sans chez vers au aux en y plus moins car "
    "lors puis deux même après avant cela ça autre "
    # Spanish
    "el los las una unos unas y o pero no que quien cual cuando donde como lo su sus se es son era eran fue hay ha han había con sin "
    "sobre entre hasta desde por para al del más menos muy ya aún otra otro ambos nos".split()
)

#: A clause has this share of function words at least.
FUNCTION_SHARE = 0.15
#: Words that alternate between function and content at this share of so many places make no clauses; the more places, the lower.
ALTERNATING = ((20, 0.92), (30, 0.85))
#: Covered clauseless characters above this share make a page stuffed.
STUFFED_SHARE = 0.5
#: A repeated substring covers if it occurs so often,
LEAST_TIMES = 2
#: holds so many letters,
LEAST_LETTERS = 3
#: and takes this share of the page's characters with all its occurrences.
LEAST_DENSITY = 0.005
#: Covered share of an item that makes it a keyword or slogan as a whole.
ITEM_SHARE = 0.3
#: Most words in the name of a price entry.
PRICE_WORDS = 4
#: So many items in a row of two to ``ENTRY_WORDS`` words with the same separator, no sentence mark, are entries of a list.
ENTRY_RUN, ENTRY_WORDS = 5, 4
#: A segment of more tokens than this without any separator is a string of items.
UNMARKED = 20

_CUT = re.compile(r"\n+|<br\s*/?>|(?<=[.!?])\s+")
_ROLE = re.compile(r"\s*(?:user|assistant|tool|system|human|q|a|question|answer)\s*:", re.I)
_STEP = re.compile(r"\s*(?:\d{1,3}[.)]|[-*•]|\[\d+\])\s*")
_SETTING = re.compile(r"(?:^|\s)[A-Za-z_]\w*=\S")
_NOTATION = re.compile(r"(?:^|[\s\"',;:])(?=[^\s\"',;]*[(\[=])[BCNOPSFIHlrcnospb0-9@+\-\[\]()=#%/\\]{6,}(?=$|[\s\"',;:.?!])")
_TOKEN = re.compile(
    r"(?P<link><[^<>]*>|\]\([^()\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|\b[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,})\b(?:/[^\s<>\"')\]]*)?)"
    r"|(?P<tag>#\w+)|(?P<number>[$€£]?\d[\d.,]*\w*%?)|(?P<sign>[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff])"
    r"|(?P<word>[^\W\d_]+(?:['’\-][^\W\d_]+)*)|(?P<mark>[^\w\s]|_)|(?P<gap>[\xa0\u2002-\u2003\t]+)"
)
#: Marks that end an item.
_ENDS = frozenset(",;|•·~!?.、。，；\t\n\xa0/")
_PRICE = re.compile(r"[$€£]?\d+(?:[.,]\d{1,2})?(?:[$€£]|eur|usd)?", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_LINK = re.compile(r"<[^<>]*>|(?:https?://|www\.)[^\s<>\"')\]]+")


def repeated(symbols: list[int], sizes: list[int], letters: list[int], least: float, times: int = LEAST_TIMES, least_letters: int = LEAST_LETTERS) -> list[bool]:
    """Which places of a sequence lie in a maximal repeated substring that covers, by its suffix automaton.

    ``sizes`` and ``letters`` are the characters and letters of each place.  A
    substring covers if it occurs ``times`` times, holds ``least_letters``
    letters and its occurrences take ``least`` characters together.

    The state after each prefix leads along suffix links to its longest suffix
    that occurs often enough, a maximal repeat to the left.  A shorter suffix of
    it occurs more often but has fewer characters, so each suffix on the way is
    tried until one covers.
    """
    n = len(symbols)
    nxt: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [0]
    last = 0
    order = []
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(1)
        order.append(cur)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(0)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    by_length = sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True)
    last_end = [0] * len(nxt)
    for i, state in enumerate(order):
        last_end[state] = i
    for s in by_length:
        up = link[s]
        if up > 0:
            ends[up] += ends[s]
            last_end[up] = max(last_end[up], last_end[s])
    upto, letters_upto = [0], [0]
    for size, many in zip(sizes, letters):
        upto.append(upto[-1] + size)
        letters_upto.append(letters_upto[-1] + many)
    # Longest covering suffix of each state's substrings; the same symbols have about the same size wherever they stand.
    best = [0] * len(nxt)
    for s in reversed(by_length):
        best[s] = best[link[s]]
        if ends[s] >= times:
            end = last_end[s] + 1
            start = end - length[s]
            if ends[s] * (upto[end] - upto[start]) >= least and letters_upto[end] - letters_upto[start] >= least_letters:
                best[s] = length[s]
    covered = [False] * n
    back = n
    for i in range(n - 1, -1, -1):
        if best[order[i]]:
            back = min(back, i + 1 - best[order[i]])
        covered[i] = back <= i
    return covered


def _is_data(s: str) -> bool:
    """Settings, objects or chemical notation."""
    return '{"' in s or _NOTATION.search(s) is not None or ("://" not in s and not s.startswith("<") and _SETTING.search(s) is not None)


def _segments(text: str) -> tuple[list[tuple[str, bool]], int]:
    """The page's segments with whether each lacks clause structure (data: no), and its visible characters."""
    cut = [s for s in _CUT.split(text) if s and not s.isspace()]
    words_of: list[list[str] | None] = []
    kinds_of: list[list[bool]] = []  # whether each word is a function word
    total = Counter()
    coarse = places = functions = 0
    for s in cut:
        if _ROLE.match(s) or ("=" in s or "(" in s or "[" in s) and _is_data(s):
            words_of.append(None)
            kinds_of.append([])
            continue
        words = _WORD.findall((_LINK.sub(" ", s) if "<" in s or "/" in s else s).lower())
        kinds = [w in FUNCTION_WORDS for w in words]
        words_of.append(words)
        kinds_of.append(kinds)
        total.update(words)
        functions += sum(kinds)
        if words:
            places += len(words) - 1
            coarse += sum(map(ne, kinds, kinds[1:]))
    contents = sum(total.values()) - functions
    # Words that take a great part of the page, ever with other neighbours.
    least = max(3, 0.03 * contents)
    often = {w for w, n in total.items() if n >= least and w not in FUNCTION_WORDS}
    stuffed = {w for w in often if total[w] >= 0.3 * contents}
    if len(stuffed) < len(often):
        before: dict[str, set[str]] = {w: set() for w in often}
        after: dict[str, set[str]] = {w: set() for w in often}
        for words in words_of:
            if words and not often.isdisjoint(words):
                for left, w, right in zip(["", *words], words, [*words[1:], ""]):
                    if w in often:
                        before[w].add(left)
                        after[w].add(right)
        stuffed |= {w for w in often if len(before[w]) >= 3 or len(after[w]) >= 3}
    strung = coarse >= 0.8 * places and _is_strung(cut, words_of)
    many = Counter(s for s, words in zip(cut, words_of) if words is not None)
    out = []
    chars = 0
    for s, words, kinds in zip(cut, words_of, kinds_of):
        chars += len(s) - s.count(" ")
        if words is None:
            out.append((s, False))
            continue
        function = sum(kinds)
        n = len(words)
        if n > 2 and function >= FUNCTION_SHARE * n:
            content = n - function
            bare = strung or many[s] >= max(5, 0.3 * len(cut)) or n <= 4 and ("<a " in s or "](" in s)
            bare = bare or stuffed and content and sum(w in stuffed for w in words) >= 0.6 * content
            out.append((s, bool(bare)))
        else:
            out.append((s, n > 0 or "#" in s or "://" in s or "<" in s))
    return out, chars


def _is_strung(cut: list[str], words_of: list[list[str] | None]) -> bool:
    """Whether function words and content words take turns between commas, as in strung keywords.

    In sentences function words stand together now and then, and so do content
    words.
    """
    places = turns = 0
    for s, words in zip(cut, words_of):
        if words and len(words) > 3:
            for part in s.split(","):
                kinds = [w.lower() in FUNCTION_WORDS for w in _WORD.findall(part)]
                if sum(kinds) >= FUNCTION_SHARE * len(kinds):
                    places += max(0, len(kinds) - 1)
                    turns += sum(map(ne, kinds, kinds[1:]))
    return any(places >= least and turns >= share * places for least, share in ALTERNATING)


def _covered(segments: list[tuple[str, bool]], chars: int) -> int:
    """Visible characters of clauseless segments in repeated substrings, links, tags and price entries."""
    tokens = []
    glued = _unglue(segments)
    opens: set[int] = set()  # where items begin in strings without separators: at words with a capital
    for s, clauseless in segments:
        first = len(tokens)
        for m in _TOKEN.finditer(s):
            kind, t = m.lastgroup, m.group()
            tokens += [(kind, part, clauseless) for part in (glued(t) if kind == "word" else (t,))]
        if len(tokens) - first > UNMARKED and not any(t in _ENDS for _, t, _ in tokens[first:]):
            opens.update(i for i in range(first, len(tokens)) if tokens[i][1].istitle())
        tokens.append(("gap", "\n", clauseless))
    ids: dict[str, int] = {}
    symbols = [ids.setdefault(t.lower() if _literal(kind, t) or kind == "mark" else "\0" + kind, len(ids)) for kind, t, _ in tokens]
    sizes = [len(t) - t.count(" ") if kind != "gap" else 0 for kind, t, _ in tokens]
    hit = repeated(symbols, sizes, [n if _literal(kind, t) else 0 for (kind, t, _), n in zip(tokens, sizes)], LEAST_DENSITY * chars)
    items: list[list[int]] = [[]]
    for i, (kind, t, _) in enumerate(tokens):
        if kind == "word" and i in opens and items[-1]:
            items.append([])
        items[-1].append(i)
        if t in _ENDS or kind in ("gap", "link"):
            items.append([])
    out = 0
    entries: list[tuple[int, int]] = []  # of the run of entries so far: all characters, those counted on their own
    last = None
    for item in items:
        if not item or not tokens[item[0]][2]:
            continue
        size, own = _item([(*tokens[j][:2], sizes[j], hit[j]) for j in item])
        out += own
        words = sum(tokens[j][0] in ("word", "number") for j in item)
        end = tokens[item[-1]][1] if tokens[item[-1]][1] in _ENDS else ""
        # The last entry of a line ends with the line and not with the separator.
        if not 2 <= words <= ENTRY_WORDS or end in ".!?" and end or end not in (last, "\n"):
            out += _entries(entries)
            entries = []
        last = end
        if 2 <= words <= ENTRY_WORDS:
            entries.append((size, own))
    return out + _entries(entries)


def _unglue(segments: list[tuple[str, bool]]) -> Callable[[str], tuple[str, ...]]:
    """A function that takes a word apart that is glued of two words of the page, the first of which occurs again."""
    counts = Counter(w for s, _ in segments for w in _WORD.findall(s.lower()))
    known: dict[str, int] = {}

    def parts(word: str) -> tuple[str, ...]:
        low = word.lower()
        if low not in known:
            cuts = (i for i in range(len(low) - LEAST_LETTERS, LEAST_LETTERS - 1, -1) if counts[low[:i]] >= LEAST_TIMES and counts[low[i:]])
            known[low] = next(cuts, 0)
        at = known[low]
        return (word[:at], word[at:]) if at else (word,)

    return parts


def _entries(run: list[tuple[int, int]]) -> int:
    """Further characters that a run of items of one shape adds."""
    return sum(size - own for size, own in run) if len(run) >= ENTRY_RUN else 0


def _literal(kind: str, t: str) -> bool:
    """Words, signs, and sizes with their unit stand for themselves."""
    return kind in ("word", "sign") or kind == "number" and not t[-1].isdigit() and t[-1] not in ".,"


def _item(tokens: list[tuple[str, str, int, bool]]) -> tuple[int, int]:
    """Characters of an item, and those that count: all of a keyword, slogan or price entry, else those covered and its links and tags."""
    size = sum(n for _, _, n, _ in tokens)
    own = sum(n for kind, _, n, h in tokens if h or kind in ("link", "tag"))
    if own >= ITEM_SHARE * size:
        return size, size
    words = [t for kind, t, _, _ in tokens if kind == "word"]
    prices = [t for kind, t, _, _ in tokens if kind == "number"]
    priced = 0 < len(words) <= PRICE_WORDS and len(prices) == 1 and _PRICE.fullmatch(prices[0].rstrip(".,"))
    return size, size if priced else own


def clauseless_share(text: str) -> tuple[list[tuple[str, bool]], int, int]:
    """A page's segments, its visible characters, and those in segments without clause structure."""
    segments, chars = _segments(text)
    return segments, chars, sum(len(s) - s.count(" ") for s, bare in segments if bare)


def measure(text: str) -> tuple[int, int, int]:
    """Visible characters, those without clause structure, and those of them that are covered."""
    segments, chars, bare = clauseless_share(text)
    return chars, bare, _covered(segments, chars)


def is_stuffed(text: str) -> bool:
    """Whether the covered characters are more than ``STUFFED_SHARE``; without an automaton where they cannot be."""
    segments, chars, bare = clauseless_share(text)
    return bare > STUFFED_SHARE * chars and _covered(segments, chars) > STUFFED_SHARE * chars


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame([measure(t) for t in pdf["text"]], columns=["chars", "clauseless", "covered"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        yield out


def _stuffed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[is_stuffed(t) for t in pdf["text"]], ["doc_id"]]


def _pages(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where(F.col("text").rlike(r"\S"))


def measure_pages(documents: DataFrame) -> DataFrame:
    """``(doc_id, chars, clauseless, covered)`` of every page with visible text; characters without blanks."""
    return python_map(_pages(documents), _measure, "doc_id bigint, chars bigint, clauseless bigint, covered bigint")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the pages that consist of keywords, links, prices and tags for more than half."""
    return python_map(_pages(documents), _stuffed, "doc_id bigint")
