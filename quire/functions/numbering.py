"""Heading numbers: patterns, classes, values and their printed forms.

Functions that read a title take it stripped, so that a plan strips it once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import NOISE_TEXT, NOISE_TITLE, SPACE, TOC_WORDS, W, col

#: Numerals, and the patterns of numbered headings in outlines.
NUMERALS = "一二三四五六七八九十百"
PART = rf"^第{W}*[{NUMERALS}零]{{1,3}}{W}*(部分|编|篇)"
CHAPTER = rf"^第{W}*[{NUMERALS}零0-9]{{1,3}}{W}*(章|回|讲)"
SECTION = rf"^第{W}*[{NUMERALS}零0-9]{{1,3}}{W}*(节|小节)"
SUBSECTION = rf"^[{NUMERALS}]{{1,3}}{W}*、{W}*[^{SPACE}]"
SUBSUBSECTION = rf"^[（(]{W}*[{NUMERALS}]{{1,3}}{W}*[）)]{W}*[^{SPACE}]"
ITEM = rf"^[0-9]{{1,2}}{W}*[.．、]{W}*[^{SPACE}]"
SUBITEM = rf"^[（(]{W}*[0-9]{{1,2}}{W}*[）)]{W}*[^{SPACE}]"
#: Whole-line titles without numbers.
OPENING = rf"^(引言|导言|导论|绪论|概述|本章导读|问题的提出|研究背景){W}*\z"
CLOSING = rf"^(结{W}*语|结论|小结|本章小结|余论|代结语|结束语|总结与展望){W}*\z"
FRONT = rf"^(序|序言|自序|代序|出版说明|凡例|编者的话){W}*[一二三四五六七八九十0-9]*{W}*\z"
BACK = rf"^(后记|跋|附录|附{W}*录|参考文献|索{W}*引|致谢|编后记|大事记){W}*[一二三四五六七八九十0-9]*{W}*\z"
#: Ranks of classes in a tree; a smaller rank is further up.
RANK = {"front": 5, "part": 10, "toc": 12, "chapter": 20, "backmatter": 20, "sec": 30, "subsec": 40, "subsubsec": 50, "item": 60, "subitem": 65}
NUMBERED = ("sec", "subsec", "subsubsec", "item", "subitem")
CHAPTER_RANKED = ("part", "chapter", "backmatter")
#: Audits read numbers by their own patterns, in this order.
TIERS = {
    "part": rf"^第{W}*([{NUMERALS}零0-9]{{1,3}}){W}*(部分|编|篇)",
    "chapter": rf"^第{W}*([{NUMERALS}零0-9]{{1,3}}){W}*(章|回|讲)",
    "sec": rf"^第{W}*([{NUMERALS}零0-9]{{1,3}}){W}*(节|小节)",
    "dun": rf"^([{NUMERALS}零]{{1,3}}){W}*、",
    "paren_zh": rf"^[（(]{W}*([{NUMERALS}零]{{1,3}}){W}*[）)]",
    "paren_ar": rf"^[（(]{W}*([0-9]{{1,2}}){W}*[）)]",
    "arabic": rf"^([0-9]{{1,2}}){W}*[.．、]",
}
PRINTED = {"part": "第{}部分", "chapter": "第{}章", "sec": "第{}节", "dun": "{}、", "paren_zh": "（{}）", "paren_ar": "（{}）", "arabic": "{}. "}
ZH_DIGITS = "零一二三四五六七八九"


def any_of(t: Column, *patterns: str) -> Column:
    """Whether any pattern matches; those that begin at the start are one pattern, tried there only."""
    anchored = [p[1:] for p in patterns if p.startswith("^")]
    tests = [t.rlike("^(?:" + "|".join(f"(?:{p})" for p in anchored) + ")")] if anchored else []
    return reduce(lambda a, b: a | b, tests + [t.rlike(p) for p in patterns if not p.startswith("^")])


def has_numbering(c: Column | str) -> Column:
    return any_of(col(c), PART, CHAPTER, SECTION, SUBSECTION, SUBSUBSECTION, ITEM, SUBITEM)


def is_structural(c: Column | str) -> Column:
    t = col(c)
    return any_of(t, PART, CHAPTER, SECTION, SUBSECTION, SUBSUBSECTION, ITEM, OPENING, CLOSING, FRONT, BACK) | t.isin(*TOC_WORDS)


def classify(c: Column | str, level: Column | str, running: Column | None = None, trusted: Column | None = None) -> Column:
    """The class of a heading candidate, null if it is none; numbers come before levels."""
    t, lv = col(c), F.coalesce(col(level), F.lit(0))
    running = F.lit(False) if running is None else F.coalesce(running, F.lit(False))
    trusted = F.lit(False) if trusted is None else trusted
    out = F.when((t == "") | t.rlike(NOISE_TEXT) | any_of(t, *NOISE_TITLE), None).when(t.isin(*TOC_WORDS), "toc").when(running, None)
    out = out.when(trusted & (lv == 1), "chapter").when(trusted & (lv != 0), "plain")
    cascade = ((PART, "part"), (CHAPTER, "chapter"), (FRONT, "chapter"), (BACK, "backmatter"), (OPENING, "opening"), (CLOSING, "closing"), (SECTION, "sec"), (SUBSECTION, "subsec"), (SUBSUBSECTION, "subsubsec"), (SUBITEM, "subitem"), (ITEM, "item"))
    for pattern, name in cascade:
        out = out.when(t.rlike(pattern), name)
    return out.when(lv == 1, "chapter").when(lv == 2, "plain")


def _digit(c: Column) -> Column:
    return F.when(F.length(c) == 1, F.instr(F.lit(ZH_DIGITS), c) - 1)


def numeral_value(c: Column | str) -> Column:
    """The value of a numeral up to 99, in digits or characters; null if it has none."""
    s = col(c)
    ten = F.instr(s, "十")
    digit = lambda x: F.greatest(F.coalesce(_digit(x), F.lit(0)), F.lit(0))
    before, after = F.substring_index(s, "十", 1), s.substr(ten + 1, F.lit(9))
    single = F.when((F.length(s) == 1) & (F.instr(F.lit(ZH_DIGITS), s) > 0), F.instr(F.lit(ZH_DIGITS), s) - 1)
    value = F.when(s.rlike(r"^[0-9]+\z"), s.try_cast("int")).when(ten == 1, 10 + digit(s.substr(2, 1))).when(ten > 1, digit(before) * 10 + F.when(after == "", 0).otherwise(digit(after)))
    return value.otherwise(single)


def numeral(n: Column | str) -> Column:
    """1..99 in characters."""
    n = col(n)
    one = lambda k: F.substring(F.lit(ZH_DIGITS), k + 1, F.lit(1))
    tail = F.when(n % 10 == 0, "").otherwise(one(n % 10))
    return F.when(n < 10, one(n)).when(n < 20, F.concat(F.lit("十"), tail)).otherwise(F.concat(one(F.floor(n / 10).cast("int")), F.lit("十"), tail))


def tier(c: Column | str) -> Column:
    """(tier, n) of a title as audits read it; both null without a number."""
    t = F.coalesce(col(c), F.lit(""))
    raw = F.array(*[F.struct(F.lit(name).alias("tier"), F.regexp_extract(t, pattern, 1).alias("raw")) for name, pattern in TIERS.items()])
    read = F.transform(F.filter(raw, lambda x: x["raw"] != ""), lambda x: F.struct(x["tier"].alias("tier"), numeral_value(x["raw"]).alias("n")))
    return F.try_element_at(F.filter(read, lambda x: x["n"].isNotNull()), F.lit(1))


def printed_number(tier_: Column | str, n: Column | str) -> Column:
    """A number as its tier prints it."""
    out = None
    for name, form in PRINTED.items():
        value = numeral(n) if name in ("part", "chapter", "sec", "dun", "paren_zh") else col(n).cast("string")
        text = F.concat(F.lit(form.split("{}")[0]), value, F.lit(form.split("{}")[1]))
        out = F.when(col(tier_) == name, text) if out is None else out.when(col(tier_) == name, text)
    return out


def locator_parts(c: Column | str) -> Column:
    """(zone, n) of a page locator: 0 body, 1 front matter, 2 none."""
    s = col(c)
    tail = F.substring_index(F.expr(f"substring({c}, 7)") if isinstance(c, str) else s.substr(7, 99), "-", 1)
    n = F.when(s.startswith("front-"), F.when(tail.rlike(r"^[0-9]+\z"), tail.try_cast("int"))).otherwise(F.when(s.rlike(r"^-?[0-9]+\z"), s.try_cast("int")))
    zone = F.when(s.startswith("front-"), 1).when(s.rlike(r"^-?[0-9]+\z"), 0).otherwise(2)
    return F.struct(zone.alias("zone"), n.alias("n"))


def roman(n: Column | str) -> Column:
    """Lower-case Roman numeral; ``?`` for numbers below one."""
    pairs = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    rest, out = col(n).cast("int"), []
    for value, sign in pairs:
        out.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(col(n) <= 0, "?").otherwise(F.concat(*out))
