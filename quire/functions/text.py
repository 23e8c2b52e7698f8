"""Text functions as column expressions.

Whitespace here is Unicode's, 29 code points, spelled out because engines disagree on
``\\s``; patterns avoid look-around so that they mean the same everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The code points that count as whitespace.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
W = f"[{SPACE}]"

#: Block types by class; any other type is unclassified.
CONTENT_TYPES = ("text", "image", "table", "chart", "equation", "interline_equation", "list", "ref_text")
NOISE_TYPES = ("header", "footer", "page_number", "aside_text", "discarded")
NOTE_TYPES = ("page_footnote",)

FULL_WIDTH, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"
TOC_WORDS = ("目录", "目 录", "Contents", "CONTENTS")

#: Descriptions of blank images that conversion leaves in texts.
NOISE_TEXT = r"(?i)^(The Ground Truth image displays\b|The (image|figure|illustration) (is|shows|displays) (a|an|the)?" + W + r"*(single|solid|blank|white))"
#: Lines that are never headings.
NOISE_TITLE = (rf"^[0-9]{{1,4}}{W}*$", rf"^[{SPACE}.·…\-—_=]+$", rf"^(图|表|Figure|Table){W}*[0-9]+", r"(?i)^(ISBN|DOI)\b")
FIGURE_CAPTION = rf"^(图|表|Figure|Table|Fig\.){W}*[0-9]+"
NUMBERED_HEADER = rf"^(序言|前言|序|目录|附录|参考文献|索引|后记|结语|绪论){W}*[·:：]?{W}*([0-9]{{1,4}})$"
SENTENCE_END = "。，；,;！？"
#: What a file name must not hold: reserved and control characters, blanks other than single spaces, dots and spaces at its ends.
UNSAFE_NAME = rf'[\\/:*?"<>|\x00-\x1f{SPACE.replace(" ", "")}]|  |^[ .]|[ .]\z'
DOWNLOAD_SITES = ("z-lib", "zlib", "z-library", "1lib", "libgen", "annas-archive", "anna's archive")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once for each row, however often later steps and filters name them.

    The optimizer copies a column's expression to wherever it is named, but doesn't look behind a generator.
    """
    for name, c in columns.items():
        rows = rows.select(*[F.col(f"`{x}`") for x in rows.columns if x != name], F.explode(F.array(c)).alias(name))
    return rows


def strip(c: Column | str) -> Column:
    """Without whitespace at both ends."""
    return F.trim(col(c), F.lit(SPACE))


def squeeze(c: Column | str) -> Column:
    """Without any whitespace."""
    return F.regexp_replace(col(c), f"{W}+", "")


def fold_digits(c: Column | str) -> Column:
    return F.translate(col(c), FULL_WIDTH, ASCII_DIGITS)


def search_key(c: Column | str) -> Column:
    """What content search compares: no whitespace, full-width digits as ASCII."""
    return fold_digits(squeeze(c))


def is_content(c: Column | str) -> Column:
    return col(c).isin(*CONTENT_TYPES)


def is_noise_text(c: Column | str) -> Column:
    """Leftover image descriptions; an empty text isn't noise."""
    t = strip(F.coalesce(col(c), F.lit("")))
    return (t != "") & t.rlike(NOISE_TEXT)


def is_plausible_heading(c: Column | str) -> Column:
    t = strip(c)
    return (t != "") & (F.length(t) <= 60) & ~F.lit(SENTENCE_END).contains(F.substring(t, -1, 1)) & ~t.contains("\n")


def page_number(c: Column | str) -> Column:
    """A page number block's number, of at most four digits; null for anything else."""
    t = F.trim(fold_digits(strip(c)), F.lit(" .·-—"))
    return F.when(t.rlike(r"^[0-9]{1,4}\z"), t.try_cast("int"))


def header_number(c: Column | str) -> Column:
    """The number of a running header such as ``附录 3``."""
    t = strip(c)
    return F.when(t.rlike(NUMBERED_HEADER), F.regexp_extract(t, NUMBERED_HEADER, 2).try_cast("int"))


def heading_level(c: Column | str) -> Column:
    """A level given as text: an optional sign and digits, null otherwise."""
    t = strip(col(c).cast("string"))
    return F.when(t.rlike(r"^-?[0-9]+\z"), t.try_cast("int"))


def clean_title(c: Column | str) -> Column:
    """Without escapes and outer marks of Markdown."""
    t = F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"\\+([*_`#\[\]()~])", "$1")
    return strip(F.regexp_replace(F.regexp_replace(t, rf"^[#*{SPACE}]+", ""), rf"[*{SPACE}]+\z", ""))


def title_key(c: Column | str) -> Column:
    """Titles of an outline and a printed contents list are the same title by this key."""
    return F.lower(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), rf"[{SPACE}·・:：,，.。;；\-—–_()（）\[\]【】\"'“”‘’!！?？]+", ""))


def contents_key(c: Column | str) -> Column:
    """The looser key for repairs from a contents list; case counts."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"[{SPACE}·．.…\-—_、，,：:（）()*]+", "")


def audit_key(c: Column | str) -> Column:
    """The key for audits: dot leaders and page numbers at the end go first."""
    t = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    for _ in range(3):
        t = F.regexp_replace(t, rf"[.．·…{SPACE}]{{2,}}[0-9]{{0,4}}{W}*\z", "")
    return F.regexp_replace(t, rf"[{SPACE}·・:：,，.。;；\-—–_()（）\[\]【】\"'“”‘’!！?？…/\\]+", "")


def is_noisy_entry(c: Column | str) -> Column:
    """A contents entry that still has dot leaders at its end."""
    return F.coalesce(col(c), F.lit("")).rlike(rf"([.．·…]{W}*){{2,}}[0-9]*{W}*\z")


def looks_like_authors(c: Column | str) -> Column:
    """The text before a page number is names rather than a title."""
    t = strip(c)
    n = F.length(squeeze(t))
    return (t == "") | (n <= 4) | ((t.contains(" ") | t.contains("\u3000") | t.endswith("等")) & (n <= 20))


def running_key(c: Column | str, structural: Column) -> Column:
    """The key by which a stripped line repeats over pages; null if it can't be a running line."""
    t = col(c)
    k = F.regexp_replace(F.regexp_replace(t, rf"^[{SPACE}0-9.·\-—]{{0,6}}", ""), f"{W}+", " ")
    k = F.trim(k, F.lit(" .·-—"))
    usable = (t != "") & (F.length(t) <= 60) & ~t.contains("\n") & ~structural & (F.length(k) >= 4)
    return F.when(usable, k)


def safe_filename(c: Column | str, most: int = 80) -> Column:
    """A file name: reserved characters to underscores, blanks squeezed, no outer dots."""
    own = col(c)
    t = F.regexp_replace(F.regexp_replace(own, r'[\\/:*?"<>|\x00-\x1f]+', "_"), f"{W}+", " ")
    t = F.substring(F.regexp_replace(t, r"^[ .]+|[ .]+\z", ""), 1, most)
    made = F.when(t == "", "untitled").otherwise(F.regexp_replace(t, r"[ .]+\z", ""))
    # most names are safe as they are, which one look tells
    return F.when((own != "") & (F.length(own) <= most) & ~own.rlike(UNSAFE_NAME), own).otherwise(made)


def strip_site_tags(c: Column | str) -> Column:
    """Without bracketed segments that name a download site."""
    sites = "|".join(s.replace("'", ".") for s in DOWNLOAD_SITES)
    return strip(F.regexp_replace(col(c), rf"(?i){W}*[\(（\[【][^\(（\[【\)）\]】]*({sites})[^\(（\[【\)）\]】]*[\)）\]】]", ""))


def source_id(name: Column | str, digest: Column | str) -> Column:
    """An identifier for a source: its name made safe and cut, and ten digits of a digest."""
    safe = F.regexp_replace(F.regexp_replace(col(name), r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", "-"), r"^-+|-+\z", "")
    return F.concat(F.substring(F.when(safe == "", "source").otherwise(safe), 1, 48), F.lit("."), F.substring(col(digest), 1, 10))


def ocr_numbers(c: Column | str) -> Column:
    """Every number of up to four digits, reading letters that OCR takes digits for."""
    return F.expr(f"regexp_extract_all(translate({c}, 'OoIl|ZSBgG', '0011125899'), '[0-9]{{1,4}}', 0)")


def trimmed(c: Column | str, n: int) -> Column:
    """Squeezed to single blanks and cut to n code points with an ellipsis."""
    t = strip(F.regexp_replace(col(c), f"{W}+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def human_size(c: Column | str, largest: str = "GB") -> Column:
    """Bytes in the unit that keeps the number under 1024, up to the largest unit asked for: MB or GB."""
    if largest not in ("MB", "GB"):
        raise ValueError("the largest unit is MB or GB")
    n = col(c).cast("double")
    step = lambda power, unit: F.format_string("%.1f " + unit, n / 1024**power)
    return F.when(n < 1024, F.format_string("%d B", col(c).cast("long"))).when(n < 1024**2, step(1, "KB")).when((n < 1024**3) | F.lit(largest == "MB"), step(2, "MB")).otherwise(step(3, "GB"))


def text_digest(c: Column | str) -> Column:
    return F.sha2(F.coalesce(col(c), F.lit("")), 256)


#: Brackets that a cut paragraph leaves open, ends of sentences, what may close one, and marks that surely go on.
BRACKETS, QUOTES = (("(", ")"), ("［", "］"), ("[", "]"), ("【", "】")), (("“", "”"),)
ENDS, CLOSERS, GOING_ON = "。！？…", "）)”』】》\"'.!?", "，、：（“‘—·"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
EDGE_CODE = r"^(`[FfEe][0-9IVXLCDM]{1,7}`\s*|[FfEe](?:[0-9]{1,4}|[IVXLCDM]{1,7})[ \t]+)"


def _open_bracket(t: Column, pairs: tuple) -> Column:
    count = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    return reduce(lambda a, b: a | b, [count(a) > count(b) for a, b in pairs])


def is_cut(c: Column | str) -> Column:
    """A paragraph that may go on after a page: an open bracket, or no end of a sentence."""
    t = col(c)
    return (F.length(t) >= 8) & (_open_bracket(t, BRACKETS) | ~F.lit(ENDS + CLOSERS).contains(F.substring(t, -1, 1)))


def is_surely_cut(c: Column | str) -> Column:
    t = col(c)
    return (t != "") & (_open_bracket(t, BRACKETS + QUOTES) | F.lit(GOING_ON).contains(F.substring(t, -1, 1)))


def is_note(c: Column | str) -> Column:
    """A text that begins with a circled number."""
    t = col(c)
    return (t != "") & F.lit(CIRCLED).contains(F.substring(t, 1, 1))


def goes_on(c: Column | str) -> Column:
    """A paragraph that may be the rest of one before it."""
    return F.regexp_replace(col(c), EDGE_CODE, "").rlike(r"^[一-鿿A-Za-z]") & ~is_note(c)
