"""Queries of outlines: text functions, headings, trees, ownership."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import numbering as num
from quire.functions import text
from quire.operators import outline as out
from quire.plans.registry import query
from quire.plans.views_sql import V2, V3
from quire.sources import views


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


W = text.W
STRIP = lambda c: f"regexp_replace({c}, {q('^' + W + '+|' + W + '+$')}, '', 'g')"
RX = lambda c, p: f"regexp_matches({c}, {q(p)})"


def rx(c: str, *patterns: str) -> str:
    return "(" + " OR ".join(RX(c, p.replace(r"\z", "$")) for p in patterns) + ")"


TYPE_IN = lambda types: "type IN (" + ", ".join(map(q, types)) + ")"

CLASSIFY = f"""CASE WHEN t = '' OR {rx('t', *text.NOISE_TITLE)} THEN NULL WHEN t IN ({', '.join(map(q, text.TOC_WORDS))}) THEN 'toc'
  WHEN {rx('t', num.PART)} THEN 'part' WHEN {rx('t', num.CHAPTER)} THEN 'chapter' WHEN {rx('t', num.FRONT)} THEN 'chapter' WHEN {rx('t', num.BACK)} THEN 'backmatter'
  WHEN {rx('t', num.OPENING)} THEN 'opening' WHEN {rx('t', num.CLOSING)} THEN 'closing' WHEN {rx('t', num.SECTION)} THEN 'sec' WHEN {rx('t', num.SUBSECTION)} THEN 'subsec'
  WHEN {rx('t', num.SUBSUBSECTION)} THEN 'subsubsec' WHEN {rx('t', num.SUBITEM)} THEN 'subitem' WHEN {rx('t', num.ITEM)} THEN 'item'
  WHEN text_level = 1 THEN 'chapter' WHEN text_level = 2 THEN 'plain' END"""


# --- block predicates and counts -------------------------------------------------------


@query("s03_blocks", f"WITH {V2} SELECT source_id, gid, shard_ord, row_number() OVER (PARTITION BY source_id, shard_ord ORDER BY gid) - 1 AS local, page_idx, type, sha256(text) AS digest FROM v2")
def s03(spark, sf):
    local = F.row_number().over(Window.partitionBy("source_id", "shard_ord").orderBy("gid")) - 1
    return views.blocks(spark, sf).select("source_id", "gid", "shard_ord", local.cast("long").alias("local"), "page_idx", "type", text.text_digest("text").alias("digest"))


@query("p01_type_classes", f"""WITH {V2} SELECT CASE WHEN {TYPE_IN(text.CONTENT_TYPES)} THEN 'content' WHEN {TYPE_IN(text.NOISE_TYPES)} THEN 'noise' WHEN {TYPE_IN(text.NOTE_TYPES)} THEN 'note' ELSE 'unclassified' END AS class,
  count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM v2 GROUP BY 1""")
def p01(spark, sf):
    kind = F.when(text.is_content("type"), "content").when(F.col("type").isin(*text.NOISE_TYPES), "noise").when(F.col("type").isin(*text.NOTE_TYPES), "note").otherwise("unclassified")
    return views.blocks(spark, sf).groupBy(kind.alias("class")).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query("p02_noise_text", f"""WITH {V2}, x AS (SELECT source_id, gid, CASE gid % 4 WHEN 0 THEN 'The image shows a single ' || text WHEN 1 THEN ' the Ground Truth image displays' ELSE text END AS text FROM v2)
SELECT source_id, gid, {STRIP('text')} <> '' AND regexp_matches({STRIP('text')}, {q(text.NOISE_TEXT)}) AS noise FROM x""")
def p02(spark, sf):
    t = F.expr("case gid % 4 when 0 then 'The image shows a single ' || text when 1 then ' the Ground Truth image displays' else text end")
    return views.blocks(spark, sf).withColumn("text", t).select("source_id", "gid", text.is_noise_text("text").alias("noise"))


@query("p03_plausible_heading", f"""WITH {V2}, x AS (SELECT source_id, gid, {STRIP('text')} AS t
  FROM v2) SELECT source_id, gid, t <> '' AND length(t) <= 60 AND right(t, 1) NOT IN ('。', '，', '；', ',', ';', '！', '？') AND NOT contains(t, chr(10)) AS plausible FROM x""")
def p03(spark, sf):
    return views.blocks(spark, sf).select("source_id", "gid", text.is_plausible_heading("text").alias("plausible"))


@query("p04_heading_gate", f"WITH {V2} SELECT source_id, gid, text_level FROM v2 WHERE type = 'text' AND (coalesce(text_level, 0) <> 0 OR {rx('text', num.PART, num.CHAPTER, num.SECTION)})")
def p04(spark, sf):
    b = views.blocks(spark, sf).withColumn("t", text.strip("text"))
    return b.filter((F.col("type") == "text") & ((F.coalesce("text_level", F.lit(0)) != 0) | num.any_of(F.col("t"), num.PART, num.CHAPTER, num.SECTION))).select("source_id", "gid", "text_level")


@query("p06_grep", f"""WITH {V2}, x AS (SELECT source_id, gid, type, regexp_replace(text, {q(W + '+')}, '', 'g') AS k, text FROM v2 WHERE NOT {TYPE_IN(text.NOISE_TYPES)})
SELECT source_id, gid, type, left(text, 400) AS text, length(text)::BIGINT AS full_len, count(*) OVER (PARTITION BY source_id) AS total FROM x WHERE contains(k, 'theof')""")
def p06(spark, sf):
    from quire.operators import review

    return review.grep(views.blocks(spark, sf), "the of")


@query("p07_list_blocks", f"""WITH {V2}, x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY gid) - 1 AS k FROM v2 WHERE contains(lower(text), 'the '))
SELECT source_id, gid, type, left(text, 220) AS text FROM x WHERE k >= 2 AND k < 10""")
def p07(spark, sf):
    from quire.operators import review

    return review.list_blocks(views.blocks(spark, sf), "The ", offset=2, limit=8)


@query("a01_unclassified_types", f"WITH {V2} SELECT type, count(*) AS blocks FROM v2 WHERE NOT {TYPE_IN(text.CONTENT_TYPES + text.NOISE_TYPES + text.NOTE_TYPES)} GROUP BY 1")
def a01(spark, sf):
    known = text.CONTENT_TYPES + text.NOISE_TYPES + text.NOTE_TYPES
    return views.blocks(spark, sf).filter(~F.col("type").isin(*known)).groupBy("type").agg(F.count("*").alias("blocks"))


RUN = f"""rk0 AS (SELECT source_id, shard_ord, page_idx, {STRIP('text')} AS t FROM v2),
rk1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, {q('^[' + text.SPACE + '0-9.·\\-—]{0,6}')}, ''), {q(W + '+')}, ' ', 'g'), '^[ .·\\-—]+|[ .·\\-—]+$', '', 'g') AS k0 FROM rk0),
rk AS (SELECT source_id, shard_ord, page_idx, CASE WHEN t <> '' AND length(t) <= 60 AND NOT contains(t, chr(10)) AND length(k0) >= 4
  AND NOT ({rx('t', num.PART, num.CHAPTER, num.SECTION, num.SUBSECTION, num.SUBSUBSECTION, num.ITEM, num.OPENING, num.CLOSING, num.FRONT, num.BACK)} OR t IN ({', '.join(map(q, text.TOC_WORDS))})) THEN k0 END AS key
  FROM rk1),
rn AS (SELECT source_id, key, count(DISTINCT (shard_ord, page_idx)) AS pages FROM rk WHERE key IS NOT NULL GROUP BY 1, 2),
rp AS (SELECT source_id, count(DISTINCT (shard_ord, page_idx)) AS of_ FROM v2 GROUP BY 1),
run AS (SELECT source_id, key, pages FROM rn JOIN rp USING (source_id) WHERE pages >= greatest(5, floor(of_ * 0.08)))"""


@query("a02_running_texts", f"WITH {V2}, {RUN} SELECT * FROM run")
def a02(spark, sf):
    return out.running_texts(views.blocks(spark, sf))


TOCL = f"""tl AS (SELECT source_id, shard_ord, page_idx, gid, CASE WHEN {rx('l', out.TOC_LINE)} OR {rx('l', out.TOC_NUMBERED)} THEN 1 ELSE 0 END AS hit
  FROM (SELECT source_id, shard_ord, page_idx, gid, {STRIP('text')} AS l FROM v2 WHERE type = 'text')),
tc AS (SELECT source_id, shard_ord, page_idx, sum(hit)::BIGINT AS lines, min(gid) AS first_gid FROM tl GROUP BY 1, 2, 3)"""


@query("a03_toc_lines", f"WITH {V2}, {TOCL} SELECT * FROM tc")
def a03(spark, sf):
    return out.toc_counts(views.blocks(spark, sf))


@query("a22_source_sizes", f"WITH {V2} SELECT source_id, count(DISTINCT shard_ord) AS shards, count(DISTINCT (shard_ord, page_idx)) AS pages, count(*) AS blocks FROM v2 GROUP BY 1")
def a22(spark, sf):
    return views.blocks(spark, sf).groupBy("source_id").agg(F.count_distinct("shard_ord").alias("shards"), F.count_distinct(F.struct("shard_ord", "page_idx")).alias("pages"), F.count("*").alias("blocks"))


@query("o01_document_order", f"WITH {V2} SELECT source_id, gid, row_number() OVER (PARTITION BY source_id ORDER BY gid, type) AS place FROM v2 WHERE type IN ('text', 'list')")
def o01(spark, sf):
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("gid", "type"))
    return views.blocks(spark, sf).filter("type in ('text', 'list')").select("source_id", "gid", place.cast("long").alias("place"))


# --- headings --------------------------------------------------------------------------

#: Titles with all kinds of numbers and words, by arithmetic on an outline's nodes.
WORDS = ("引言", "结论", "附录 二", "序言", "目录", "图 3 样", "ISBN 7-5000", "Chapter", "正文第一节之后，", "1999")
HEADS = f"""hh AS (SELECT source_id, seq, CASE WHEN seq % 3 = 0 THEN list_extract([{', '.join(map(q, WORDS))}], (1 + (source_id + seq) % {len(WORDS)})::INTEGER) ELSE title || '标题' END AS text,
  CASE WHEN source_id % 3 = 0 THEN NULL ELSE source_id % 3 END AS text_level FROM v3), hs AS (SELECT *, {STRIP('text')} AS t FROM hh)"""


def heads(spark, sf):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (1 + (F.col("source_id") + F.col("seq")) % len(WORDS)).cast("int"))
    o = views.outline(spark, sf)
    return o.select("source_id", "seq", F.when(F.col("seq") % 3 == 0, word).otherwise(F.concat("title", F.lit("标题"))).alias("text"), F.expr("case when source_id % 3 = 0 then null else source_id % 3 end").alias("text_level"))


@query("f04_classify", f"WITH {V3}, {HEADS} SELECT source_id, seq, text, {CLASSIFY} AS marker FROM hs")
def f04(spark, sf):
    return heads(spark, sf).withColumn("t", text.strip("text")).select("source_id", "seq", "text", num.classify("t", "text_level").alias("marker"))


ZH = lambda c: f"""CASE WHEN regexp_matches({c}, '^[0-9]+$') THEN {c}::BIGINT WHEN {c} LIKE '十%' THEN 10 + greatest(0, strpos('零一二三四五六七八九', substr({c}, 2, 1)) - 1) * CASE WHEN length({c}) > 1 THEN 1 ELSE 0 END
  WHEN contains({c}, '十') THEN greatest(0, strpos('零一二三四五六七八九', split_part({c}, '十', 1)) - 1) * 10 + CASE WHEN split_part({c}, '十', 2) = '' THEN 0 ELSE greatest(0, strpos('零一二三四五六七八九', split_part({c}, '十', 2)) - 1) END
  WHEN length({c}) = 1 AND strpos('零一二三四五六七八九', {c}) > 0 THEN strpos('零一二三四五六七八九', {c}) - 1 END"""  # noqa: E731
TIER = "nt0 AS (SELECT *, CASE " + " ".join(f"WHEN {rx('title', p)} THEN {q(n)}" for n, p in num.TIERS.items()) + " END AS tier, coalesce(" + ", ".join(f"nullif(regexp_extract(title, {q(p)}, 1), '')" for p in num.TIERS.values()) + f") AS raw FROM v3), nt AS (SELECT *, {ZH('raw')} AS n FROM nt0)"


@query("f05_numbering", f"WITH {V3}, {TIER} SELECT source_id, seq, title, tier, n FROM nt")
def f05(spark, sf):
    o = views.outline(spark, sf).withColumn("x", num.tier("title"))
    return o.select("source_id", "seq", "title", "x.tier", F.col("x.n").cast("long").alias("n"))


@query("f06_numerals", """SELECT n, CASE WHEN n < 10 THEN substr('零一二三四五六七八九', n + 1, 1) WHEN n < 20 THEN '十' || CASE WHEN n = 10 THEN '' ELSE substr('零一二三四五六七八九', n % 10 + 1, 1) END ELSE substr('零一二三四五六七八九', n // 10 + 1, 1) || '十' || CASE WHEN n % 10 = 0 THEN '' ELSE substr('零一二三四五六七八九', n % 10 + 1, 1) END END AS zh, n AS value
  FROM (SELECT unnest(range(1, 100)) AS n)""")
def f06(spark, sf):
    r = spark.range(1, 100).select(F.col("id").alias("n"), num.numeral(F.col("id").cast("int")).alias("zh"))
    return r.withColumn("value", num.numeral_value("zh").cast("long"))


@query("f07_printed_numbers", f"""WITH {V3}, {TIER}
  SELECT source_id, seq, CASE tier WHEN 'part' THEN '第' || raw || '部分' WHEN 'chapter' THEN '第' || raw || '章' WHEN 'sec' THEN '第' || raw || '节' WHEN 'dun' THEN raw || '、' WHEN 'paren_zh' THEN '（' || raw || '）' WHEN 'paren_ar' THEN '（' || raw || '）' ELSE raw || '. ' END AS printed
  FROM nt""")
def f07(spark, sf):
    o = views.outline(spark, sf).withColumn("x", num.tier("title"))
    return o.select("source_id", "seq", num.printed_number("x.tier", F.col("x.n")).alias("printed"))


@query("f08_roman", """SELECT n, CASE WHEN n <= 0 THEN '?' ELSE repeat('m', (n // 1000)::INTEGER) || list_extract(['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'], (n % 1000 // 100 + 1)::INTEGER) || list_extract(['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'], (n % 100 // 10 + 1)::INTEGER) || list_extract(['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'], (n % 10 + 1)::INTEGER) END AS roman
  FROM (SELECT unnest(range(0, 3000)) AS n)""")
def f08(spark, sf):
    return spark.range(3000).select(F.col("id").alias("n"), num.roman("id").alias("roman"))


P1 = f"[{text.SPACE}·・:：,，.。;；\\-—–_()（）\\[\\]【】\"'“”‘’!！?？]+"
P2 = f"[{text.SPACE}·．.…\\-—_、，,：:（）()*]+"
P3 = f"[{text.SPACE}·・:：,，.。;；\\-—–_()（）\\[\\]【】\"'“”‘’!！?？…/\\\\]+"
LEAD = f"[.．·…{text.SPACE}]{{2,}}[0-9]{{0,4}}{W}*$"


def _titles(spark, sf):
    from quire.session import table

    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" （"), F.col("doc_id"), F.lit("）…… 12")).alias("s"))


@query("f11_title_keys", f"""WITH x AS (SELECT doc_id, text || ' （' || doc_id || '）…… 12' AS s FROM documents)
SELECT doc_id, lower(regexp_replace({STRIP('s')}, {q(P1)}, '', 'g')) AS outline_key, regexp_replace(s, {q(P2)}, '', 'g') AS contents_key,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace({STRIP('s')}, {q(LEAD)}, ''), {q(LEAD)}, ''), {q(LEAD)}, ''), {q(P3)}, '', 'g') AS audit_key, regexp_replace(s, {q(W + '+')}, '', 'g') AS plain_key FROM x""")
def f11(spark, sf):
    return _titles(spark, sf).select("doc_id", text.title_key("s").alias("outline_key"), text.contents_key("s").alias("contents_key"), text.audit_key("s").alias("audit_key"), text.squeeze("s").alias("plain_key"))


@query("f10_clean_title", f"""WITH x AS (SELECT doc_id, '## \\*' || text || '\\[1\\] **' AS s FROM documents)
SELECT doc_id, {STRIP("regexp_replace(regexp_replace(regexp_replace(" + STRIP('s') + ", '\\\\+([*_`#\\[\\]()~])', '\\1', 'g'), " + q(f'^[#*{text.SPACE}]+') + ", ''), " + q(f'[*{text.SPACE}]+$') + ", '')")} AS title FROM x""")
def f10(spark, sf):
    from quire.session import table

    return table(spark, sf, "documents").select("doc_id", text.clean_title(F.concat(F.lit("## \\*"), "text", F.lit("\\[1\\] **"))).alias("title"))


@query("f09_running_keys", f"WITH {V2}, {RUN} SELECT source_id, shard_ord, page_idx, key, count(*) AS lines FROM rk WHERE key IS NOT NULL GROUP BY ALL")
def f09(spark, sf):
    b = views.blocks(spark, sf).withColumn("t", text.strip("text")).withColumn("key", text.running_key("t", num.is_structural("t"))).filter("key is not null")
    return b.groupBy("source_id", "shard_ord", "page_idx", "key").agg(F.count("*").alias("lines"))


@query("f12_authors", f"""WITH {V2}, x AS (SELECT source_id, gid, {STRIP('text')} AS t FROM v2),
y AS (SELECT *, length(regexp_replace(t, {q(W + '+')}, '', 'g')) AS n
  FROM x) SELECT source_id, gid, t = '' OR n <= 4 OR ((contains(t, ' ') OR contains(t, '　') OR ends_with(t, '等')) AND n <= 20) AS authors FROM y""")
def f12(spark, sf):
    return views.blocks(spark, sf).select("source_id", "gid", text.looks_like_authors("text").alias("authors"))


@query("f14_page_numbers", """WITH x AS (SELECT doc_id, ' ·' || translate(doc_id::VARCHAR, '0123456789', CASE WHEN doc_id % 2 = 0 THEN '０１２３４５６７８９' ELSE '0123456789' END) || CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN '00' ELSE ' — ' END AS s
  FROM documents),
y AS (SELECT doc_id, regexp_replace(translate(s, '０１２３４５６７８９', '0123456789'), '^[ .·\\-—]+|[ .·\\-—]+$', '', 'g') AS t
  FROM x) SELECT doc_id, CASE WHEN regexp_matches(t, '^[0-9]{1,4}$') THEN t::BIGINT END AS n FROM y""")
def f14(spark, sf):
    from quire.session import table

    wide = F.when(F.col("doc_id") % 2 == 0, F.translate(F.col("doc_id").cast("string"), text.ASCII_DIGITS, text.FULL_WIDTH)).otherwise(F.col("doc_id").cast("string"))
    s = F.concat(F.lit(" ·"), wide, F.expr("case doc_id % 5 when 0 then 'a' when 1 then '00' else ' — ' end"))
    return table(spark, sf, "documents").select("doc_id", text.page_number(s).cast("long").alias("n"))


@query("f15_header_numbers", f"""WITH {V3}, x AS (SELECT source_id, seq, list_extract(['序言', '附录 ', '前言·', '正文', '索引：'], (1 + seq % 5)::INTEGER) || number AS s
  FROM v3) SELECT source_id, seq, CASE WHEN {rx('s', text.NUMBERED_HEADER)} THEN regexp_extract(s, {q(text.NUMBERED_HEADER)}, 2)::BIGINT END AS n FROM x""")
def f15(spark, sf):
    head = F.element_at(F.array(*map(F.lit, ("序言", "附录 ", "前言·", "正文", "索引："))), (1 + F.col("seq") % 5).cast("int"))
    return views.outline(spark, sf).select("source_id", "seq", text.header_number(F.concat(head, F.col("number"))).cast("long").alias("n"))


@query("f16_locator_parts", f"""WITH {V3}, x AS (SELECT source_id, seq, CASE seq % 4 WHEN 0 THEN 'front-' || number WHEN 1 THEN number::VARCHAR WHEN 2 THEN 'front-' || number || '-P1-s' || seq END AS loc
  FROM v3)
  SELECT source_id, seq, CASE WHEN loc LIKE 'front-%' THEN 1 WHEN loc IS NULL THEN 2 ELSE 0 END AS zone, CASE WHEN loc LIKE 'front-%' THEN split_part(loc[7:], '-', 1)::BIGINT ELSE loc::BIGINT END AS n
  FROM x""")
def f16(spark, sf):
    loc = F.expr("case seq % 4 when 0 then concat('front-', number) when 1 then cast(number as string) when 2 then concat('front-', number, '-P1-s', seq) end")
    o = views.outline(spark, sf).withColumn("loc", loc).withColumn("p", num.locator_parts("loc"))
    return o.select("source_id", "seq", F.col("p.zone").alias("zone"), F.col("p.n").cast("long").alias("n"))


@query("f17_noisy_entries", f"""WITH {V3}, x AS (SELECT source_id, seq, title || list_extract(['', '… …', '...', '·· 12', '.'], (1 + number % 5)::INTEGER) AS s
  FROM v3) SELECT source_id, seq, regexp_matches(s, {q('([.．·…]' + W + '*){2,}[0-9]*' + W + '*$')}) AS noisy FROM x""")
def f17(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, ("", "… …", "...", "·· 12", "."))), (1 + F.col("number") % 5).cast("int"))
    return views.outline(spark, sf).select("source_id", "seq", text.is_noisy_entry(F.concat("title", tail)).alias("noisy"))


@query("f21_search_keys", f"""WITH {V2}
  SELECT source_id, gid, sha256(regexp_replace(text, {q(W + '+')}, '', 'g')) AS verify_key, translate(regexp_replace('第１２ ' || gid, {q(W + '+')}, '', 'g'), '０１２３４５６７８９', '0123456789') AS grep_key
  FROM v2""")
def f21(spark, sf):
    return views.blocks(spark, sf).select("source_id", "gid", F.sha2(text.squeeze("text"), 256).alias("verify_key"), text.search_key(F.concat(F.lit("第１２ "), F.col("gid"))).alias("grep_key"))


@query("f24_ocr_numbers", f"WITH {V2} SELECT source_id, gid, array_to_string(regexp_extract_all(translate(text, 'OoIl|ZSBgG', '0011125899'), '[0-9]{{1,4}}'), ',') AS numbers FROM v2")
def f24(spark, sf):
    return views.blocks(spark, sf).select("source_id", "gid", F.array_join(text.ocr_numbers("text"), ",").alias("numbers"))


@query("f27_trimmed", f"""WITH {V2}, x AS (SELECT source_id, gid, {STRIP('regexp_replace(text, ' + q(W + '+') + ', chr(32), chr(103))')} AS t
  FROM v2) SELECT source_id, gid, CASE WHEN length(t) <= 40 THEN t ELSE left(t, 39) || '…' END AS short FROM x""")
def f27(spark, sf):
    return views.blocks(spark, sf).select("source_id", "gid", text.trimmed("text", 40).alias("short"))


@query("f30_text_digests", "SELECT doc_id, sha256(text) AS sha256, left(sha256(text), 12) AS short FROM documents")
def f30(spark, sf):
    from quire.session import table

    d = text.text_digest("text")
    return table(spark, sf, "documents").select("doc_id", d.alias("sha256"), F.substring(d, 1, 12).alias("short"))


@query("s05_heading_levels", f"""WITH {V3}, x AS (SELECT source_id, seq, CASE seq % 5 WHEN 0 THEN ' ' || level WHEN 1 THEN '-' || level WHEN 2 THEN 'h' || level WHEN 3 THEN '' ELSE level || '.0' END AS s
  FROM v3) SELECT source_id, seq, CASE WHEN regexp_matches(trim(s), '^-?[0-9]+$') THEN trim(s)::BIGINT END AS level FROM x""")
def s05(spark, sf):
    s = F.expr("case seq % 5 when 0 then concat(' ', level) when 1 then concat('-', level) when 2 then concat('h', level) when 3 then '' else concat(level, '.0') end")
    return views.outline(spark, sf).select("source_id", "seq", text.heading_level(s).cast("long").alias("level"))


# --- trees -----------------------------------------------------------------------------

TREE = f"""{V3}, pr AS (SELECT a.source_id, a.seq, max(b.seq) AS parent FROM v3 a LEFT JOIN v3 b ON b.source_id = a.source_id AND b.seq < a.seq AND b.level < a.level GROUP BY 1, 2),
nd AS (SELECT v.*, p.parent FROM v3 v JOIN pr p USING (source_id, seq)),
od AS (SELECT *, row_number() OVER (PARTITION BY source_id, parent ORDER BY seq) AS ordinal FROM nd),
tr AS (SELECT source_id, seq, parent, title, level, ordinal, ordinal::VARCHAR AS nid, 1::BIGINT AS depth, ''::VARCHAR AS crumbs, page_idx, number, chars, blocks, tier_no FROM od WHERE parent IS NULL
 
  UNION ALL
  SELECT o.source_id, o.seq, o.parent, o.title, o.level, o.ordinal, t.nid || '.' || o.ordinal, t.depth + 1, CASE WHEN t.crumbs = '' THEN t.title ELSE t.crumbs || ' › ' || t.title END, o.page_idx, o.number, o.chars, o.blocks, o.tier_no
  FROM od o JOIN tr t ON t.source_id = o.source_id AND t.seq = o.parent)"""
RTREE = f"WITH RECURSIVE {TREE}"


def tree(spark, sf):
    return out.with_parents(views.outline(spark, sf))


def titled_tree(spark, sf):
    """Nodes with the titles of those around them."""
    return out.with_parents(views.outline(spark, sf).select("source_id", "seq", "level", "title"), title="title")


@query("j06_parents", f"{RTREE} SELECT source_id, seq, level, parent FROM nd")
def j06(spark, sf):
    return out.with_parents(views.outline(spark, sf)).select("source_id", "seq", "level", "parent")


@query("w23_node_ids", f"{RTREE} SELECT source_id, seq, ordinal, nid, depth FROM tr")
def w23(spark, sf):
    return tree(spark, sf).select("source_id", "seq", "ordinal", "nid", "depth")


@query("j22_breadcrumbs", f"{RTREE} SELECT source_id, seq, crumbs FROM tr")
def j22(spark, sf):
    return out.breadcrumbs(titled_tree(spark, sf)).select("source_id", "seq", "crumbs")


@query("k04_index_rows", f"{RTREE} SELECT source_id, seq, replace(title, '|', '\\|') AS title, CASE WHEN length(crumbs) > 44 THEN '…' || right(crumbs, 42) ELSE crumbs END AS belongs_to FROM tr")
def k04(spark, sf):
    t = out.breadcrumbs(titled_tree(spark, sf))
    short = F.when(F.length("crumbs") > 44, F.concat(F.lit("…"), F.expr("right(crumbs, 42)"))).otherwise(F.col("crumbs"))
    return t.select("source_id", "seq", F.replace("title", F.lit("|"), F.lit("\\|")).alias("title"), short.alias("belongs_to"))


UP = """up AS (SELECT source_id, seq AS anc, seq, chars, blocks FROM tr UNION ALL SELECT u.source_id, t.parent, u.seq, u.chars, u.blocks FROM up u JOIN tr t ON t.source_id = u.source_id AND t.seq = u.anc WHERE t.parent IS NOT NULL)"""


@query("a06_rollup", f"{RTREE}, {UP} SELECT source_id, anc AS seq, sum(chars)::BIGINT AS total_chars, sum(blocks)::BIGINT AS total_blocks, count(*) AS nodes FROM up GROUP BY 1, 2")
def a06(spark, sf):
    return out.rolled_up(out.with_parents(views.outline(spark, sf)))


@query("j05_ancestor_pairs", f"{RTREE}, {UP} SELECT source_id, seq, anc AS ancestor FROM up WHERE anc <> seq")
def j05(spark, sf):
    return out.with_parents(views.outline(spark, sf)).select("source_id", "seq", F.explode("ancestors").alias("ancestor"))


@query("a05_level_stats", f"""WITH {V3}
  SELECT source_id, level, count(*) AS nodes, count(*) AS files_if_split, sum(chars)::BIGINT AS chars, min(chars) AS min_chars, max(chars) AS max_chars, count(*) FILTER (blocks = 0) AS empty, floor(sum(chars) / count(*))::BIGINT AS avg_chars
  FROM v3 GROUP BY 1, 2""")
def a05(spark, sf):
    return out.level_stats(views.outline(spark, sf))


@query("a11_deep_nodes", f"WITH {V3} SELECT level, count(*) AS nodes, count(*) FILTER (level > 3) AS below_focus FROM v3 GROUP BY 1")
def a11(spark, sf):
    return views.outline(spark, sf).groupBy("level").agg(F.count("*").alias("nodes"), F.count_if(F.col("level") > 3).alias("below_focus"))


@query("t13_frontier", f"""{RTREE}, lf AS (SELECT t.*, NOT EXISTS (SELECT 1 FROM tr c WHERE c.source_id = t.source_id AND c.parent = t.seq) AS leaf FROM tr t)
SELECT source_id, seq, nid, depth, CASE WHEN depth = 2 OR leaf THEN 'piece' ELSE 'introduction' END AS kind FROM lf WHERE depth <= 2""")
def t13(spark, sf):
    return out.frontier(tree(spark, sf), 2).select("source_id", "seq", "nid", "depth", "kind")


@query("p11_toc_export", f"""{RTREE}, {UP}, tt AS (SELECT source_id, anc AS seq, sum(chars)::BIGINT AS n_chars FROM up GROUP BY 1, 2), ch AS (SELECT t.source_id, t.parent AS seq, sum(x.n_chars)::BIGINT AS below FROM tr t JOIN tt x USING (source_id, seq) WHERE t.parent IS NOT NULL GROUP BY 1, 2)
SELECT t.source_id, row_number() OVER (PARTITION BY t.source_id ORDER BY t.seq) AS seq, t.nid, t.depth, t.title, x.n_chars AS chars, x.n_chars - coalesce(c.below, 0) AS own_chars FROM tr t JOIN tt x USING (source_id, seq) LEFT JOIN ch c USING (source_id, seq) WHERE t.depth <= 3""")
def p11(spark, sf):
    t = tree(spark, sf)
    total = out.rolled_up(t).select("source_id", "seq", F.col("total_chars").alias("n_chars"))
    t = t.select("source_id", "seq", "parent", "nid", "depth", "title").join(total, ["source_id", "seq"])
    below = t.filter("parent is not null").groupBy("source_id", F.col("parent").alias("seq")).agg(F.sum("n_chars").alias("below"))
    rows = t.join(below, ["source_id", "seq"], "left").filter("depth <= 3")
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("seq")).cast("long")
    return rows.select("source_id", n.alias("seq"), "nid", "depth", "title", F.col("n_chars").alias("chars"), (F.col("n_chars") - F.coalesce("below", F.lit(0))).alias("own_chars"))


BRK = f"""{V2}, bk AS (SELECT source_id, gid, 0::BIGINT AS off_, gid::VARCHAR AS key FROM v2 WHERE type = 'text' AND text_level IS NOT NULL),
ow AS (SELECT v.*, b.key FROM v2 v ASOF LEFT JOIN bk b ON v.source_id = b.source_id AND v.gid >= b.gid)"""


def owned(spark, sf):
    b = views.blocks(spark, sf)
    marks = b.filter("type = 'text' and text_level is not null").select("source_id", "gid", F.lit(0).cast("long").alias("offset"), F.col("gid").cast("string").alias("key"))
    return out.owners(b, marks)


@query("j04_block_owner", f"WITH {BRK} SELECT source_id, gid, key FROM ow")
def j04(spark, sf):
    return owned(spark, sf).select("source_id", "gid", "key")


@query("t09_own_content", f"""WITH {BRK} SELECT source_id, key, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM ow WHERE {TYPE_IN(text.CONTENT_TYPES)} AND {STRIP('text')} <> '' GROUP BY 1, 2""")
def t09(spark, sf):
    return out.own_content(owned(spark, sf))


@query("t12_front_nodes", f"WITH {BRK} SELECT source_id, min(gid) AS first_heading, min(gid) > 0 AS needs_front FROM bk GROUP BY 1")
def t12(spark, sf):
    b = views.blocks(spark, sf).filter("type = 'text' and text_level is not null")
    return b.groupBy("source_id").agg(F.min("gid").alias("first_heading"), (F.min("gid") > 0).alias("needs_front"))


@query("w24_key_suffixes", f"""WITH {V3}, x AS (SELECT source_id, seq, number::VARCHAR AS key, row_number() OVER (PARTITION BY source_id, number ORDER BY seq) AS k
  FROM v3) SELECT source_id, seq, CASE WHEN k > 1 THEN key || '#' || (seq - 1) ELSE key END AS key FROM x""")
def w24(spark, sf):
    k = F.row_number().over(Window.partitionBy("source_id", "number").orderBy("seq"))
    key = F.col("number").cast("string")
    return views.outline(spark, sf).withColumn("k", k).select("source_id", "seq", F.when(F.col("k") > 1, F.concat(key, F.lit("#"), F.col("seq") - 1)).otherwise(key).alias("key"))


@query("t02_heading_candidates", f"""WITH {V2}, {RUN}, {TOCL}, bz AS (SELECT source_id, arg_max(struct_pack(s := shard_ord, p := page_idx), struct_pack(a := lines, b := -first_gid)) AS st FROM tc WHERE lines >= 3 GROUP BY 1),
cd AS (SELECT v.*, {STRIP('text')} AS t FROM v2 v WHERE type = 'text' AND coalesce(text_level, 0) <> 0),
ck AS (SELECT c.*, r.key IS NOT NULL AS runs, b.st, f.source_id IS NOT NULL AS figure FROM cd c LEFT JOIN bz b USING (source_id)
  LEFT JOIN (SELECT DISTINCT source_id, shard_ord, page_idx FROM (SELECT *, {STRIP('text')} AS t
  FROM v2 WHERE type = 'text') WHERE {rx('t', text.FIGURE_CAPTION)}) f USING (source_id, shard_ord, page_idx)
 
  LEFT JOIN run r ON r.source_id = c.source_id AND r.key = regexp_replace(regexp_replace(regexp_replace(c.t, {q('^[' + text.SPACE + '0-9.·\\-—]{0,6}')}, ''), {q(W + '+')}, ' ', 'g'), '^[ .·\\-—]+|[ .·\\-—]+$', '', 'g')),
dr AS (SELECT *, CASE WHEN t = '' OR length(t) > 60 OR right(t, 1) IN ('。', '，', '；', ',', ';', '！', '？') THEN 'implausible' WHEN runs OR ({CLASSIFY}) IS NULL THEN 'noise' END AS drop_reason
  FROM ck WHERE st IS NULL)
SELECT source_id, gid, CASE WHEN drop_reason IS NULL THEN {CLASSIFY} END AS marker, drop_reason FROM dr""")
def t02(spark, sf):
    b = views.blocks(spark, sf)
    regions = out.toc_regions(b)
    found = out.heading_candidates(b, regions, out.running_texts(b))
    return found.join(regions, "source_id", "left_anti").select("source_id", "gid", "marker", "drop_reason")


TOCV = """tv AS (SELECT source_id, seq * 2 AS ord, CASE WHEN seq % 4 = 0 THEN '第一部分' WHEN seq % 3 = 0 THEN title || '的标题' ELSE title || '的标题……' || (page_idx + 40) END AS line FROM v3
  UNION ALL SELECT source_id, seq * 2 + 1, '……某某 ' || (page_idx + 40) FROM v3 WHERE seq % 3 = 0 AND seq % 4 <> 0)"""


def toc_lines_view(spark, sf):
    o = views.outline(spark, sf)
    first = o.select("source_id", (F.col("seq") * 2).alias("ord"), F.expr("case when seq % 4 = 0 then '第一部分' when seq % 3 = 0 then concat(title, '的标题') else concat(title, '的标题……', page_idx + 40) end").alias("line"))
    second = o.filter("seq % 3 = 0 and seq % 4 <> 0").select("source_id", (F.col("seq") * 2 + 1).alias("ord"), F.expr("concat('……某某 ', page_idx + 40)").alias("line"))
    return first.unionByName(second)


PN = out.TOC_PAGE_NUMBER.replace(r"\z", "$").replace("\\u3000", "　")
TOCE = f"""{TOCV}, te0 AS (SELECT *, {rx('line', num.PART)} AS part, regexp_matches(line, {q(PN)}) AS numbered FROM tv),
te1 AS (SELECT *, lag(CASE WHEN NOT part AND NOT numbered THEN line END) OVER (PARTITION BY source_id ORDER BY ord) AS pending FROM te0),
te2 AS (SELECT *, {STRIP("CASE WHEN regexp_matches(line, '[.．·…]{2,}') THEN regexp_replace(line, '[.．·…]{2,}.*$', '') ELSE regexp_replace(line, " + q(PN) + ", '') END")} AS head
  FROM te1 WHERE part OR numbered),
te AS (SELECT source_id, ord, CASE WHEN part THEN 'part' ELSE 'chapter' END AS kind, CASE WHEN part THEN line ELSE CASE WHEN head = '' OR length(head) <= 4 THEN coalesce(nullif(pending, ''), head) ELSE head END END AS title, CASE WHEN NOT part THEN regexp_extract(line, {q(PN)}, 2)::BIGINT END AS printed FROM te2)"""


@query("t04_printed_toc", f"WITH {V3}, {TOCE} SELECT * FROM te WHERE kind = 'part' OR length(title) >= 3")
def t04(spark, sf):
    return out.printed_toc(toc_lines_view(spark, sf))


def entry_match(k: str, t: str) -> str:
    """SQL for whether a title says a contents entry."""
    return f"""CASE WHEN length({k}) < 4 THEN {k} = {t}
      ELSE (length({t}) >= 4 AND (contains({t}, {k}) OR contains({k}, {t}))) OR (length({t}) >= 2 AND starts_with({k}, {t})) END"""


def repair_sql(page_known: str, gid: str) -> str:
    """SQL for the entries that no title matches, one after the other, as what is added counts as a title."""
    return f"""WITH RECURSIVE {V3}, {TOCE},
e AS (SELECT *, regexp_replace(title, {q(P2)}, '', 'g') AS k, {page_known} AS page_known, {gid} AS gid, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS n
  FROM te WHERE kind = 'chapter' AND length(title) >= 3 AND printed IS NOT NULL AND printed <> 0),
ts AS (SELECT DISTINCT source_id, regexp_replace(title || '的标题', {q(P2)}, '', 'g') AS t FROM v3 WHERE seq % 5 <> 1),
es AS (SELECT *, k = '' OR EXISTS (SELECT 1 FROM ts WHERE ts.source_id = e.source_id AND ts.t <> '' AND {entry_match('k', 't')}) AS known FROM e),
rp AS (SELECT DISTINCT source_id, 0::BIGINT AS n, []::VARCHAR[] AS added, NULL::BIGINT AS ord, NULL::VARCHAR AS status FROM e
  UNION ALL SELECT source_id, n, CASE WHEN status = 'added' THEN list_append(added, k) ELSE added END, ord, status
  FROM (SELECT r.source_id, es.n, r.added, es.k, es.ord,
      CASE WHEN es.known OR len(list_filter(r.added, lambda x: {entry_match('es.k', 'x')})) > 0 THEN NULL WHEN NOT es.page_known THEN 'no page' WHEN es.gid IS NULL THEN 'no block' ELSE 'added' END AS status
    FROM rp r JOIN es ON es.source_id = r.source_id AND es.n = r.n + 1))"""


def _repair_titles(spark, sf):
    return views.outline(spark, sf).filter("seq % 5 <> 1").select("source_id", F.concat("title", F.lit("的标题")).alias("title"))


@query("j07_missing_entries", f"{repair_sql('true', '0')} SELECT rp.source_id, rp.ord, e.title, e.printed FROM rp JOIN e ON e.source_id = rp.source_id AND e.ord = rp.ord WHERE status = 'added'")
def j07(spark, sf):
    return out.missing_entries(out.printed_toc(toc_lines_view(spark, sf)), _repair_titles(spark, sf))


@query("t06_repaired_entries", f"{repair_sql('printed % 11 <> 0', 'CASE WHEN printed % 7 <> 0 THEN printed END')} SELECT source_id, ord, status FROM rp WHERE status IS NOT NULL")
def t06(spark, sf):
    e = out.printed_toc(toc_lines_view(spark, sf)).withColumn("page_known", F.expr("printed % 11 <> 0")).withColumn("gid", F.expr("case when printed % 7 <> 0 then printed end"))
    return out.repaired_entries(e, _repair_titles(spark, sf))


@query("j08_first_blocks", f"""WITH {V2}, w AS (SELECT DISTINCT source_id, shard_ord, p AS page_idx FROM v2, (SELECT unnest([0, 2, 5, 8]) AS p)), f AS (SELECT source_id, shard_ord, page_idx, min(gid) AS gid FROM v2 GROUP BY 1, 2, 3)
SELECT w.source_id, w.shard_ord, w.page_idx, arg_min(f.gid, f.page_idx) AS gid FROM w LEFT JOIN f ON f.source_id = w.source_id AND f.shard_ord = w.shard_ord AND f.page_idx BETWEEN w.page_idx AND w.page_idx + 3 GROUP BY 1, 2, 3""")
def j08(spark, sf):
    b = views.blocks(spark, sf)
    pages = b.select("source_id", "shard_ord").distinct().withColumn("page_idx", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 2, 5, 8)])))
    return out.first_blocks(pages, b)


@query("w16_misread_entries", f"""WITH RECURSIVE {V3},
e AS (SELECT source_id, seq AS ord, page_idx * 5 AS printed, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM v3),
st AS (SELECT DISTINCT source_id, 0::BIGINT AS n, NULL::BIGINT AS last_, NULL::BIGINT AS bad FROM e
  UNION ALL SELECT s.source_id, e.n, CASE WHEN e.printed < s.last_ - 3 THEN s.last_ ELSE e.printed END, CASE WHEN e.printed < s.last_ - 3 THEN e.ord END
  FROM st s JOIN e ON e.source_id = s.source_id AND e.n = s.n + 1)
SELECT source_id, bad AS ord FROM st WHERE bad IS NOT NULL""")
def w16(spark, sf):
    o = views.outline(spark, sf)
    return out.misread_entries(o.select("source_id", F.col("seq").alias("ord"), (F.col("page_idx") * 5).alias("printed")))


def greedy_sql(nodes: str, node_key: str, entry_key: str, short: str) -> str:
    """SQL for the greedy match, node by node; each takes the first entry that is left."""
    return f"""WITH RECURSIVE {V3}, {TOCE},
en AS (SELECT source_id, ord, {entry_key} AS key FROM te WHERE kind = 'part' OR length(title) >= 3),
nd AS (SELECT source_id, seq, {node_key} AS key, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM (SELECT source_id, seq, title || '的标题' AS title FROM v3 WHERE {nodes})),
mt AS (SELECT nd.source_id, nd.n, en.ord FROM nd JOIN en ON en.source_id = nd.source_id
  WHERE CASE WHEN least(length(nd.key), length(en.key)) < 4 THEN {short} ELSE contains(nd.key, en.key) OR contains(en.key, nd.key) END),
gr AS (SELECT DISTINCT source_id, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS seq, NULL::BIGINT AS ord FROM nd
  UNION ALL (SELECT g.source_id, g.n + 1, CASE WHEN min(m.ord) IS NULL THEN g.taken ELSE list_append(g.taken, min(m.ord)) END, any_value(nd.seq), min(m.ord)
    FROM gr g JOIN nd ON nd.source_id = g.source_id AND nd.n = g.n + 1 LEFT JOIN mt m ON m.source_id = g.source_id AND m.n = g.n + 1 AND NOT list_contains(g.taken, m.ord)
    GROUP BY g.source_id, g.n, g.taken))
SELECT source_id, seq, ord FROM gr WHERE ord IS NOT NULL"""


CONTENTS_KEY = f"regexp_replace(title, {q(P2)}, '', 'g')"
AUDIT_KEY = STRIP("title")
for _ in range(3):
    AUDIT_KEY = f"regexp_replace({AUDIT_KEY}, {q(LEAD)}, '')"
AUDIT_KEY = f"regexp_replace({AUDIT_KEY}, {q(P3)}, '', 'g')"


@query("j09_toc_crosscheck", greedy_sql("level <= 2", CONTENTS_KEY, CONTENTS_KEY, "false"))
def j09(spark, sf):
    o = views.outline(spark, sf).filter("level <= 2")
    nodes = o.select("source_id", "seq", text.contents_key(F.concat("title", F.lit("的标题"))).alias("key"))
    entries = out.printed_toc(toc_lines_view(spark, sf)).select("source_id", "ord", text.contents_key("title").alias("key"))
    return out.matched_entries(nodes, entries, short_equal=False)


@query("j10_audit_match", greedy_sql("true", AUDIT_KEY, AUDIT_KEY, "nd.key <> '' AND nd.key = en.key"))
def j10(spark, sf):
    o = views.outline(spark, sf)
    nodes = o.select("source_id", "seq", text.audit_key(F.concat("title", F.lit("的标题"))).alias("key"))
    entries = out.printed_toc(toc_lines_view(spark, sf)).select("source_id", "ord", text.audit_key("title").alias("key"))
    return out.matched_entries(nodes, entries)


def names_sql(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, names)) + ")"


#: The rank of a marker, and the step from one heading to the next with the chain of open ones.
RANK_OF = "CASE marker " + " ".join(f"WHEN {q(m)} THEN {r}" for m, r in num.RANK.items()) + " END"
NUMBERED, CHAPTERS = names_sql(num.NUMBERED), names_sql(num.CHAPTER_RANKED)
AHEAD = "OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def ranks_sql(rows: str) -> str:
    """CTEs after rows(source_id, seq, marker, unnumbered, in_toc): rk holds rank and parent_seq of each; needs WITH RECURSIVE."""
    return f"""ra AS (SELECT *, {RANK_OF} AS own, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n,
    first_value(CASE WHEN marker IN {NUMBERED} THEN {RANK_OF} WHEN marker IN {CHAPTERS} THEN -1 END IGNORE NULLS) {AHEAD} AS for_plain,
    first_value(CASE WHEN marker IN {NUMBERED} THEN {RANK_OF} WHEN marker IN {CHAPTERS} OR marker IN ('opening', 'closing') THEN -1 END IGNORE NULLS) {AHEAD} AS for_held FROM {rows}),
rs AS (SELECT DISTINCT source_id, 0::BIGINT AS n, []::STRUCT(r INTEGER, s BIGINT)[] AS open_, false AS back, NULL::BIGINT AS seq, NULL::INTEGER AS rank, NULL::BIGINT AS parent_seq FROM ra
  UNION ALL SELECT source_id, n, CASE WHEN marker IN ('toc', 'front') THEN above ELSE list_append(above, struct_pack(r := rank, s := seq)) END, back, seq, rank, above[-1].s
  FROM (SELECT *, list_filter(open_, lambda x: x.r < rank) AS above
    FROM (SELECT *, CASE WHEN back AND marker = 'chapter' AND unnumbered AND NOT in_toc THEN 30
        WHEN marker = 'plain' THEN CASE WHEN for_plain > 0 THEN for_plain WHEN len(open_) > 0 THEN open_[-1].r + 5 ELSE 20 END
        WHEN marker IN ('opening', 'closing') THEN CASE WHEN for_held > 0 THEN for_held ELSE coalesce(list_filter(open_, lambda x: x.r <= 20)[-1].r, 20) + 20 END
        ELSE own END::INTEGER AS rank
      FROM (SELECT s.open_, s.back OR ra.marker = 'backmatter' AS back, ra.* FROM rs s JOIN ra ON ra.source_id = s.source_id AND ra.n = s.n + 1)))),
rk AS (SELECT source_id, seq, rank, parent_seq FROM rs WHERE seq IS NOT NULL)"""


HAS_NUMBER = rx("t", num.PART, num.CHAPTER, num.SECTION, num.SUBSECTION, num.SUBSUBSECTION, num.ITEM, num.SUBITEM)


@query("t07_ranked_tree", f"""WITH RECURSIVE {V3}, {HEADS}, hc AS (SELECT *, {CLASSIFY} AS marker FROM hs),
hr AS (SELECT source_id, seq, marker, NOT ({HAS_NUMBER}) AS unnumbered, false AS in_toc FROM hc WHERE marker IS NOT NULL), {ranks_sql('hr')} SELECT * FROM rk""")
def t07(spark, sf):
    c = heads(spark, sf).withColumn("t", text.strip("text")).withColumn("marker", num.classify("t", "text_level")).filter("marker is not null")
    rows = c.select("source_id", "seq", "marker", (~num.has_numbering("t")).alias("unnumbered"), F.lit(False).alias("in_toc"), F.lit(0).alias("trusted_level"))
    return out.ranked_tree(rows)
