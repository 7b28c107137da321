"""Problem 8: sentence units of texts in any language and script.

Statistics over all documents, by language and without labels, by log-likelihood ratios: of a type and a following period
(abbreviations), of a word and a sure sentence end before it (sentence starters), and of a type with its period and the
type that follows (collocations); besides, what follows each type with its period (starters, digits, lower case). Each period
is then classified by them; the other marks, quotations, brackets, lists and scripts without spaces follow rules.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.session import discard, materialise
from fieldloom.sources.tables import table

#: A type enters the model from this count on.
LEAST_COUNT = 4
#: Least score of an abbreviation; a starter follows a sure end in this share of its uses, a word inside sentences in less than INSIDE.
ABBREVIATION, STARTER, INSIDE = 0.3, 0.5, 0.3
#: Least log-likelihood ratio of a sentence starter, and of a collocation.
STARTER_RATIO, COLLOCATION = 30.0, 7.88
#: An abbreviation before a digit ends no sentence if digits follow it more often than this; before an unknown name if starters do less often.
DIGITS, ENDS = 0.15, 0.25
#: Letters of words whose period is taken for a sentence end when starters are counted.
LONG_WORD = 5

# Marks, quotation marks, brackets, and the commonest words that tell languages of the Latin script apart.
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
LIST_MARK = re.compile(r"[ \t﻿]*(?:(?:#{1,6}(?=\s)|[-*+•‣▪◦–](?=\s)|>|\(?\d{1,3}[.)](?=\s)|\(?[a-z][)](?=\s))[ \t]*)+")
LABEL = re.compile(r"[A-ZÀ-ÞА-Я][A-ZÀ-ÞА-Я0-9_ -]{1,24}:\s")
ENDS_MARK = re.compile(r"[.!?…。！？｡।॥؟۔‼⁇⁈⁉．]+")
OPEN_CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", '"': '"', "〝": "〞"}
BRACKETS = set("([{（【《〈")
CLOSING = ")]}）】》〉」』”’»›〞\"'“«"
CLOSERS = set(")]}）】》〉」』”’»›〞\"'“«")
PAIR = re.compile(r"[()\[\]{}（）【】《》〈〉「」『』“”„«»‘’‚‹›\"〝〞]")
OPENERS = "([{（【《〈「『“„«»‘‚‹\"〝¿¡'"
SAYS = re.compile(r"[^。！？，；]{0,30}?(?:写道|说|問|问道|表示|回答|喊道)")
THAI_GAP = re.compile(r"(?<=[฀-๿])[  　\t]+(?=[฀-๿])")
THAI = re.compile(r"[\u0e01-\u0e7f]")
WORD = re.compile(r"[^\W\d_][^\W\d_\u0300-\u036f\u0900-\u097f]*")
SEPARATE = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[ \t\xa0\u3000]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*")
MARKS_AT_LINE = re.compile(r"(?m)^[ \t]*(?:#{1,6}|[-*+•‣▪◦–>]|\(?\d{1,3}[.)])[ \t]")
STRIP = "“”\"«»()[]{}‘’'„‚¿¡!?.,;:…-–—*_"
COMMON = {
    "en": "the a an of and in to is that it by for was no if with on from",
    "de": "der die das den dem des und ein eine einen nicht ist von im zu auf mit",
    "fr": "le la les un une des et du de en puis qui que dans est ne pas",
    "es": "el la los las un una y del de en que se con por es al no",
}
COMMON_OF: dict[str, list[str]] = {}
for _lang, _words in COMMON.items():
    for _w in _words.split():
        COMMON_OF.setdefault(_w, []).append(_lang)
# The scripts' blocks.
SCRIPTS = (("ja", re.compile(r"[\u3041-\u3096\u30a1-\u30fa\uff66-\uff9d]")), ("zh", re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")), ("th", re.compile(r"[\u0e01-\u0e7f]")), ("hi", re.compile(r"[\u0900-\u097f]")), ("ar", re.compile(r"[\u0600-\u06ff\u0750-\u077f]")), ("ru", re.compile(r"[\u0400-\u052f]")))
FOREIGN = re.compile(r"[\u0400-\u052f\u0600-\u06ff\u0750-\u077f\u0900-\u097f\u0e01-\u0e7f\u3041-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d]")
LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")


def language(block: str, declared: str | None) -> str:
    """The language of a whole block by its most frequent script, and by common words within the Latin one; else the declared one."""
    if not block.isascii() and FOREIGN.search(block):
        n = {name: len(pattern.findall(block)) for name, pattern in SCRIPTS}
        # Japanese is written in both: kana among Han characters make it so, unless they are few
        both = n["ja"] + n["zh"]
        east = "ja" if n["ja"] * 8 >= n["zh"] else "zh"
        n["ja"], n["zh"] = (both, 0) if east == "ja" else (0, both)
        name = max(n, key=n.__getitem__)
        if n[name] and n[name] * 4 >= len(LATIN.findall(block)):
            return name
    score: dict[str, int] = {}
    for w in filter(COMMON_OF.__contains__, block.lower().split()):
        for lang in COMMON_OF[w]:
            score[lang] = score.get(lang, 0) + 1
    if score:
        most = max(score.values())
        best = [lang for lang, n in score.items() if n == most]
        if len(best) == 1:
            return best[0]
    return (declared or "en").lower()[:2]


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, body): stretches that no sentence crosses, and where their text begins after the marks that open them.

    A blank line and a line break before a list mark end a block; so does the line break after a heading.
    """
    out, at, start, body, heading = [], 0, None, 0, False
    edges = [m.span() for m in BREAK.finditer(text)] + [(len(text), len(text))]
    last = 0
    for end, nxt in edges:
        blank = not text[at:end].strip().strip("﻿").strip()
        mark = None if blank else LIST_MARK.match(text, at, end)
        if start is not None and (blank or mark or heading):
            out.append((start, last, body))
            start = None
        if not blank:
            if start is None:
                start, body = at, mark.end() if mark else at
                label = LABEL.match(text, body, end)
                body = label.end() if label else body
            heading = bool(mark) and "#" in mark[0]
            last = end
        at = nxt
    if start is not None:
        out.append((start, last, body))
    return out


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in PAIR.finditer(text, start, end):
        c, i = m[0], m.start()
        before = text[i - 1] if i > start else " "
        after = text[i + 1] if i + 1 < end else " "
        if c == "’" and before.isalnum() and after.isalnum():
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in OPEN_CLOSE[stack[k][0]]), None)
        if k is not None:
            o = stack[k][1]
            del stack[k:]
            found = [f for f in found if not (o < f[0])]
            found.append((o, i))
        elif c in OPEN_CLOSE:
            stack.append((c, i))
    found.sort()
    return found


@dataclass
class Model:
    """Of each language: starters, words found inside sentences, (digit share, end share) of each abbreviation, and collocations."""

    starters: set[tuple[str, str]] = field(default_factory=set)
    inside: set[tuple[str, str]] = field(default_factory=set)
    short: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    together: set[tuple[str, str, str]] = field(default_factory=set)


def _key(w: str) -> str:
    """The type of a word before a period: numbers by their digits, initials as one."""
    if w.isdigit():
        return f"#{min(len(w), 4)}"
    if len(w) == 1 and (w.isupper() or not w.islower()):
        return "#initial"
    return w.lower()


INITIAL = re.compile(r"[^\W\d_]\.")


def _type(t: str) -> str:
    """The type of a token without opening marks: its first word; initials are one type; empty without a word."""
    m = WORD.match(t)
    if not m:
        return ""
    return "#initial" if m.end() == 1 and INITIAL.match(t) and t[0].isupper() else m[0]


def observe(text: str, declared: str | None, counts: dict[str, Counter], pairs: Counter, sure: Counter) -> None:
    """Add a text's tokens by language, its pairs (token with a period, follower), and the tokens that follow sure ends."""
    for block in SEPARATE.split(text):
        lang = language(block, declared)
        tokens = ["\x01", *MARKS_AT_LINE.sub(" \x01 ", block).split()]  # \x01: the start of a block or item
        counts[lang].update(tokens)
        before = ""
        for w, t in zip(tokens, tokens[1:]):
            c = w[-1]
            if c == ".":
                pairs[lang, w, t] += 1
                if len(w) == 2 and before[-1:] != ".":
                    pairs[lang, f"{before} {w}", t] += 1
            elif c == "\x01":
                sure[lang, t] += 1
            elif c in "?!”\"»’)":
                bare = w.rstrip("”\"»’)")
                if bare and bare[-1] in "?!.":
                    sure[lang, t] += 1
            before = w


def _events(counts: dict[str, Counter], pairs: Counter, sure: Counter) -> Counter:
    """(language, kind, a, b) and their counts: t uses of a word, s its uses after a sure end, p a type with its period and what follows."""
    out: Counter = Counter()
    for lang, tokens in counts.items():
        for raw, n in tokens.items():
            w = raw.lstrip(STRIP)
            if INITIAL.fullmatch(w) and w[0].isupper():
                out[lang, "t", "#initial", ""] += n
                continue
            m = WORD.match(w)
            if m and raw.rstrip("”\"»’)")[-1:] != ".":  # "No." is another type than "No"
                out[lang, "t", m[0], ""] += n
    for (lang, raw), n in sure.items():
        w = _type(raw.lstrip(STRIP))
        if w:
            out[lang, "s", w, ""] += n
    for (lang, raw, nxt), n in pairs.items():
        w = raw[:-1].lstrip(STRIP)
        if not w or w[-1] in ".?!":
            continue
        t = nxt.lstrip("“\"«»(¿¡‘„")
        follower = _type(t)
        if " " in w:
            word, _, w = w.partition(" ")
            if _key(w) == "#initial" and follower and word.isalpha():
                out[lang, "p", f"#initial {word.lower()}", follower] += n
            continue
        if w.isdigit() or not any(c.isdigit() for c in w):
            out[lang, "p", _key(w), follower or ("0" if t[:1].isdigit() else "")] += n
    return out


def _ratio(together: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events that occur `first` and `second` times among `total`, `together` at once; 0 if they avoid each other."""
    rest, n1 = F.greatest(total - first, F.lit(1)), F.greatest(first, F.lit(1))
    others = F.greatest(second - together, F.lit(0))
    safe = lambda q: F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
    like = lambda k, n, q: k * F.log(safe(q)) + F.greatest(n - k, F.lit(0)) * F.log(1 - safe(q))
    p1, p2, p = together / n1, others / rest, second / F.greatest(total, F.lit(1))
    return F.when(p1 <= p2, 0.0).otherwise(2 * (like(together, n1, p1) + like(others, rest, p2) - like(together, n1, p) - like(others, rest, p)))


def score(with_period: int, without: int, tokens: int, periods: int, kind: str) -> float:
    """Log-likelihood ratio of a type and a following period, scaled down for long types and uses without one."""
    n, p = with_period + without, max(min(periods / max(tokens, 1), 0.999), 1e-6)
    like = lambda k, n, q: k * log(max(q, 1e-12)) + (n - k) * log(max(1 - q, 1e-12))
    ratio = 2 * (like(with_period, n, 0.99) - like(with_period, n, p))
    letters = len(kind.replace(".", ""))
    return ratio * exp(-letters) * (kind.count(".") + 1) * letters ** -min(without, 50)


def _score(with_period, without, tokens, periods, kind) -> Column:
    """score() of columns, but for the last digits."""
    with_period, without, tokens, periods, kind = (F.col(c) if isinstance(c, str) else c for c in (with_period, without, tokens, periods, kind))
    n, p = with_period + without, F.greatest(F.least(periods / F.greatest(tokens, F.lit(1)), F.lit(0.999)), F.lit(1e-6))
    like = lambda k, q: k * F.log(F.greatest(q, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - q, F.lit(1e-12)))
    letters = F.length(F.replace(kind, F.lit("."), F.lit("")))
    return 2 * (like(with_period, F.lit(0.99)) - like(with_period, p)) * F.exp(-letters) * (F.length(kind) - letters + 1) * F.pow(letters, -F.least(without, F.lit(50)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The statistics over all texts."""

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        pairs, sure = Counter(), Counter()
        for b in batches:
            for t, declared in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    observe(t, declared, counts, pairs, sure)
            if len(pairs) + sum(map(len, counts.values())) > 300_000:
                yield _rows(_events(counts, pairs, sure))
                for c in (counts, pairs, sure):
                    c.clear()
        yield _rows(_events(counts, pairs, sure))

    def _rows(counts: Counter) -> pa.RecordBatch:
        keys = list(zip(*counts)) if counts else [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "a", "b", "n"])

    seen = materialise(docs.where(F.length(text) > 0).select(text, lang).mapInArrow(run, "lang string, kind string, a string, b string, n bigint").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")), "p8-counts", "kind")
    totals = {(r.lang, r.kind): r.n for r in seen.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}

    # every type from LEAST_COUNT on is scored where it lies; only those that may be abbreviations come to the driver
    digits = F.sum(F.when(F.col("b") == "0", F.col("n")).otherwise(0)).alias("digits")
    periods = seen.where("kind = 'p'").groupBy("lang", "a").agg(F.sum("n").alias("n"), digits).where(F.col("n") >= LEAST_COUNT)
    sums = F.broadcast(docs.sparkSession.createDataFrame([(lang, totals.get((lang, "t"), 1), totals.get((lang, "p"), 1)) for lang in {lang for lang, _ in totals}], "lang string, tokens bigint, periods bigint"))  # a row a language
    lower = seen.where("kind = 't'").groupBy("lang", F.lower("a").alias("a")).agg(F.sum("n").alias("uses"))
    short, shares = [], {}
    likely = F.col("a").startswith("#") | (_score("n", F.coalesce("uses", F.lit(0)), "tokens", "periods", "a") >= 0.99 * ABBREVIATION) | ((F.col("digits") >= 3) & (F.col("digits") > 2 * DIGITS * F.col("n")))
    for r in periods.join(lower, ["lang", "a"], "left").join(sums, "lang").where(likely).collect():
        without = r.uses or 0
        shortened = r.a.startswith("#") or score(r.n, without, totals.get((r.lang, "t"), 1), totals.get((r.lang, "p"), 1), r.a) >= ABBREVIATION
        if shortened or (r.digits >= 3 and r.digits > 2 * DIGITS * r.n):
            short.append((r.lang, r.a, shortened))
            shares[r.lang, r.a] = r.digits / r.n
    uses = seen.where("kind = 't'").where(F.col("n") >= LEAST_COUNT).select("lang", "a", F.col("n").alias("uses"))
    first = F.substring("b", 1, 1)
    upper = (first != F.lower(first)) | ~first.rlike(r"\p{Ll}")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    tokens = seen.where("kind = 't'").groupBy("lang").agg(F.sum("n").alias("tokens"))
    final, rates = set(), []
    for _ in range(2):
        # a period after a type that is no abbreviation, or that mostly ends sentences all the same, starts the word after it
        marked = [(lang, a, shortened and (lang, a) not in final and (len(a) < LONG_WORD or "." in a)) for lang, a, shortened in short]
        kinds = F.broadcast(docs.sparkSession.createDataFrame(marked, "lang string, a string, shortened boolean"))  # likely abbreviations
        after = seen.where("kind = 'p' and b not in ('', '0') and a not like '#%'").join(kinds.where("shortened"), ["lang", "a"], "left_anti").select("lang", F.col("b").alias("a"), "n")
        starts = seen.where("kind = 's'").select("lang", "a", "n").unionAll(after).groupBy("lang", "a").agg(F.sum("n").alias("starts"))
        whole = starts.groupBy("lang").agg(F.sum("starts").alias("all")).join(tokens, "lang", "left")  # a row a language
        known = uses.join(starts, ["lang", "a"], "left").join(F.broadcast(whole), "lang", "left").na.fill(0, ["starts", "all", "tokens"])
        rate = (F.col("starts") + 0.5) / (F.col("uses") + 1)
        enough = _ratio(F.col("starts"), F.col("all"), F.greatest("uses", "starts"), F.greatest("tokens", "all")) >= STARTER_RATIO
        rated = known.withColumns({"rate": rate, "starter": (F.col("a") != "#initial") & (rate >= STARTER) & enough})
        discard(*rates)
        rates = [materialise(rated, "p8-rates")]
        followed = seen.where("kind = 'p' and b not in ('', '0')").join(kinds, ["lang", "a"]).join(rates[0].select("lang", F.col("a").alias("b"), "starter"), ["lang", "b"], "left")
        seen_after = followed.groupBy("lang", "a").agg(total(upper & F.coalesce("starter", F.lit(False))).alias("ends"), total(upper).alias("uppers"), F.sum("n").alias("n")).collect()
        final = {(r.lang, r.a) for r in seen_after if r.ends >= STARTER * r.n}
    ends = {(r.lang, r.a): r.ends / max(r.uppers, 1) for r in seen_after}
    short_ = {k: (v, ends.get(k, 0.0)) for k, v in shares.items()}
    # words inside sentences, and collocations, matter where the type before the period does not settle the matter by itself
    halves = sorted({lang for (lang, a), (_, e) in short_.items() if ENDS <= e < 0.5})
    # the splitter asks only for words that begin with a capital whether they occur inside sentences
    told = rates[0].where(F.col("starter") | (F.col("lang").isin(halves) & (F.col("rate") < INSIDE) & ~F.col("a").rlike(r"^\p{IsLowercase}"))).select("lang", "a", "starter").collect()
    starters, inside = ({(r.lang, r.a) for r in told if r.starter == kind} for kind in (True, False))
    open_, together = [(lang, a) for (lang, a), (_, e) in short_.items() if 0.05 <= e < 0.95], set()
    if open_:
        chosen = F.broadcast(docs.sparkSession.createDataFrame(open_, "lang string, a string"))
        all_periods = seen.where("kind = 'p'").groupBy("lang", "a").agg(F.sum("n").alias("periods"))
        pairs = seen.where("kind = 'p' and b not in ('', '0')").where(F.col("n") >= LEAST_COUNT).join(chosen, ["lang", "a"]).join(all_periods, ["lang", "a"])
        pairs = pairs.join(rates[0].where("not starter").select("lang", F.col("a").alias("b"), "uses", "starts", "all", "tokens"), ["lang", "b"])
        # more frequent after the type than at sure starts: the period between them is not an end
        apart = F.col("n") * F.greatest("all", F.lit(1)) > 2 * F.col("starts") * F.col("periods")
        kept = pairs.where(apart & (_ratio(F.col("n"), F.col("periods"), F.greatest("uses", "n"), F.greatest("tokens", F.lit(1))) >= COLLOCATION))
        together = {(r.lang, r.a, r.b) for r in kept.collect()}
    model = Model(starters, inside, short_, together)
    discard(seen, *rates)
    return model


def _kind(c: str) -> str:
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    return "letter" if c.isalpha() else "other"


CJK = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaffぁ-ヿｦ-ﾟ]")


class Splitter:
    def __init__(self, model: Model):
        self.model = model

    def _follower(self, text: str, at: int, end: int) -> tuple[str, str, bool]:
        """Kind and type of the next token, and whether an opening mark stands before it."""
        k, opened = at, False
        while k < end and (text[k] in OPENERS or (opened and text[k].isspace())):
            k, opened = k + 1, True
        if k < end and text[k] in "—–" and k + 1 < end and text[k + 1].isalpha():
            k, opened = k + 1, True
        if k >= end:
            return "other", "", opened
        m = WORD.match(text, k, end)
        token = m[0] if m else ""
        if len(token) == 1 and token.isupper() and k + 1 < end and text[k + 1] == ".":
            token = "#initial"
        return _kind(text[k]), token, opened

    def _glued(self, text: str, start: int, s: int, at: int, end: int, lang: str) -> bool:
        """May a sentence end at the mark at s although the next word at `at` follows without a space?"""
        m = WORD.match(text, at, end)
        if not m or not text[at].isupper() or not (text[s - 1].islower() or text[s - 1].isdigit() or text[s - 1] in CLOSERS):
            return False
        if not (lang, m[0]) in self.model.starters and not (m.end() - at > 1 and m[0][1:].islower()):
            return False
        w = self._words(text, start, s)[-1]
        return not any(c in w for c in "/\\@:_#") and ("." not in w or not any(c.isalpha() for c in w))

    @staticmethod
    def _words(text: str, start: int, s: int) -> list[str]:
        """The last two words before s, in full, and perhaps some before them."""
        width = 40
        while True:
            words = text[max(start, s - width) : s].split()
            if len(words) > 2 or s - width <= start:
                return words
            width *= 4

    def _period(self, text: str, start: int, s: int, at: int, end: int, lang: str) -> bool:
        """Does the single period at s, with text going on at `at`, end a sentence?"""
        words = self._words(text, start, s)
        w = words[-1].lstrip(STRIP).rstrip(CLOSING) if words and not text[s - 1].isspace() else ""
        last = w[-1:]
        if last and (0x0E00 <= ord(last) <= 0x0E7F or 0x0900 <= ord(last) <= 0x097F):
            return False
        kind, token, opened = self._follower(text, at, end)
        starter = (lang, token) in self.model.starters
        if kind == "lower":
            return starter
        key = _key(w) if w else ""
        short = self.model.short.get((lang, key))
        if key == "#initial":
            # an initial before a name goes on; not so the letter after a word whose letters mostly end sentences
            after = self.model.short.get((lang, f"#initial {words[-2].lower()}")) if len(words) > 1 else None
            return starter or (opened and kind != "digit") or (after is not None and after[1] >= STARTER)
        if not starter and (lang, key, token) in self.model.together:
            return False
        if key.startswith("#"):
            if starter or kind in ("digit", "other"):
                return True
            return short is None or short[1] >= INSIDE
        if short is None:
            return True
        digits, ends = short
        if kind == "digit":
            return digits < DIGITS
        if starter:
            return True
        if kind == "upper" and ends < 0.5 and (lang, token) in self.model.inside:
            return False
        return ends >= ENDS

    def _mark(self, text: str, start: int, s: int, e: int, at: int, end: int, lang: str) -> bool:
        """Does the cluster of marks [s, e) outside quotations, with text going on at `at`, end a sentence?"""
        marks, nxt, gap = text[s:e], text[at], at > e
        if nxt in ",;:،؛、，；：%" or (nxt in "—–-" and not (at + 1 < end and text[at + 1].isalnum())):
            return False
        if any(c in "。！？｡।॥؟۔" for c in marks):
            return True
        if "!" in marks or "?" in marks or any(c in "‼⁇⁈⁉" for c in marks):
            if not gap and not CJK.match(nxt) and nxt not in OPENERS and not self._glued(text, start, s, at, end, lang):
                return False
            kind, token, _ = self._follower(text, at, end)
            return kind != "lower" or (lang, token) in self.model.starters
        if len(marks) > 1 or marks == "…":
            if not gap and (CJK.match(nxt) or CJK.match(text, s - 1)):
                return lang != "ja"
            if not gap and nxt not in OPENERS and not self._glued(text, start, s, at, end, lang):
                return False
            kind, token, _ = self._follower(text, at, end)
            return kind != "lower" or (lang, token) in self.model.starters
        return (gap or self._glued(text, start, s, at, end, lang)) and self._period(text, start, s, at, end, lang)

    def _closed(self, text: str, begins: bool, o: int, c: int, at: int, end: int, lang: str) -> bool:
        """Does a quotation or bracket (o, c) whose last words end a sentence end the one round it?"""
        nxt, gap = text[at], at > c + 1
        if nxt in ",;:،؛、，；：" or ENDS_MARK.match(nxt) or (nxt in "—–-" and not (at + 1 < end and text[at + 1].isalnum())):
            return False
        if text[o] in BRACKETS and not begins:
            return False
        if CJK.match(nxt) or (not gap and lang in ("zh", "ja")):
            if 0x3041 <= ord(nxt) <= 0x3096:
                return False
            return not (lang == "zh" and begins and SAYS.match(text, at, min(end, at + 48)))
        if not gap and nxt not in OPENERS:
            return False
        kind, token, _ = self._follower(text, at, end)
        return kind != "lower" or (lang, token) in self.model.starters

    def split(self, text: str, declared: str | None = None) -> list[tuple[int, int]]:
        out = []
        for s, e, body in blocks(text):
            cuts = self._cuts(text, body, e, language(text[body:e], declared))
            for a, b in zip([s, *cuts], [*cuts, e]):
                while a < b and (text[a].isspace() or text[a] == "﻿"):
                    a += 1
                while a < b and (text[b - 1].isspace() or text[b - 1] == "﻿"):
                    b -= 1
                if a < b:
                    out.append((a, b))
        return out

    def _cuts(self, text: str, start: int, end: int, lang: str) -> list[int]:
        cuts: list[int] = []
        spans = _spans(text, start, end)
        opens = [o for o, _ in spans]
        inner: dict[int, list[tuple[int, int, int]]] = {}
        sentence = start

        def skip(i: int) -> int:
            while i < end and (text[i].isspace() or text[i] == "﻿"):
                i += 1
            return i

        for m in ENDS_MARK.finditer(text, start, end):
            s, e = m.span()
            k = bisect.bisect_right(opens, s) - 1
            if k >= 0 and spans[k][1] > s:
                o, c = spans[k]
                if text[e:c].strip("    　’”»\"'）)』」"):
                    after = e
                    while after < c and text[after] in CLOSERS:
                        after += 1
                    at = skip(after)
                    if at < c and self._mark(text, o + 1, s, e if after == e else after, at, c, lang):
                        inner.setdefault(k, []).append((s, after, at))
                    continue
                after = c + 1
                while after < end and text[after] in CLOSERS and not (text[after] in OPENERS and after + 1 < end and text[after + 1].isalnum()):
                    after += 1
                at = skip(after)
                begins = not text[sentence:o].strip("  　\t\r\n﻿-–—>")
                if at >= end:
                    done = True
                elif m[0] == "." and text[o] in BRACKETS and not begins:
                    done = False
                else:
                    done = self._closed(text, begins, o, c, at, end, lang)
                if done:
                    if begins:
                        cuts += [x[1] for x in inner.get(k, ())]
                    if at < end:
                        cuts.append(after)
                        sentence = at
                continue
            after = e
            while after < end and text[after] in CLOSERS and not (text[after] in OPENERS and after + 1 < end and (text[after + 1].isalnum() or text[after + 1] == " ")):
                after += 1
            at = after
            if at < end and not text[at].isspace():
                if e == s + 1 and text[s] == "." and at == e and not text[at].isupper():
                    continue  # inside a number, a name or an address
            else:
                at = skip(after)
            if at < end and self._mark(text, start, s, after, at, end, lang):
                cuts.append(after)
                sentence = at
        if not text.isascii() and THAI.search(text, start, end):
            for m in THAI_GAP.finditer(text, start, end):
                k = bisect.bisect_right(opens, m.start()) - 1
                if k < 0 or spans[k][1] < m.start():
                    cuts.append(m.start())
        return sorted(set(cuts))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """(key, sent_start, sent_end): sentence units in code points, end exclusive.

    Null, empty and blank texts give no row; a null or wrong language is made good from the text. Only the named columns are
    read. Without a model one is fitted on all of docs first.
    """
    model = fit(docs, text, lang) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # abbreviations, starters, collocations and capitalised words, not all types

    def run(batches):
        splitter = Splitter(shared.value)
        for b in batches:
            ids, n, starts, ends = b.column(0), [], [], []
            for t, declared in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                units = splitter.split(t, declared) if t else []
                n.append(len(units))
                starts += [u[0] for u in units]
                ends += [u[1] for u in units]
            take = pa.array([i for i, k in enumerate(n) for _ in range(k)], pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "sent_start", "sent_end"])

    return docs.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias(key), text, lang).mapInArrow(run, f"{key} bigint, sent_start int, sent_end int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
