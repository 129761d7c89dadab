"""Chinese text: character classes, script, spam signals and quality rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.quality import first_reason

#: Ranges of ideographs.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{F900}-\x{FAFF}"
#: Characters that tell the traditional and the simplified script.
TRADITIONAL = "們來時這個說國後會對應也從於他她學現發問題與為話體樣進過點還實際間愛藝術電語書報紙習工作生活歷史關係政治經濟文化社展變"
SIMPLIFIED = "们来时这个说国后会对应也从于他她学现发问题与为话实际间点体样进过还爱艺术电语书报纸习工作生活历史关系政治经济文化社展变"
PUNCTUATION = "，。！？；：「」『』【】〔〕〈〉《》〖〗、·…—～（）"
#: Name, weight and pattern of the spam signals.
SPAM = [
    ("star_rating_spam", 0.5, "[★☆]{3,}"), ("click_bait", 2.0, "(点击|立即|马上|快速)(下载|购买|领取|注册|登录)"), ("promo_lure", 2.0, "(免费|优惠|折扣|特价).{0,5}(领取|获取|下载)"),
    ("wechat_drain", 3.0, "(加微信|加QQ|加我|扫码).{0,10}(咨询|了解|获取)"), ("phone_number", 0.5, "[0-9]{11}"), ("url_count", 0.3, r"(http|https|www)[^\s]{3,50}"),
    ("char_repetition", 1.0, r"(.)\1{4,}"), ("share_lucky_draw", 3.0, "(转发|分享|点赞).{0,5}(抽奖|免费|赢)"), ("seo_terms", 1.5, "(?i)SEO|关键词优化|百度排名|搜索引擎优化"),
]


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(T.text_of(c), F.lit(pattern))


def n_chinese(c: Column) -> Column:
    return count(c, f"[{CJK}]")


def char_ratios(c: Column) -> dict[str, Column]:
    """Shares of ideographs, other letters, digits, punctuation, white space and the rest, to four places; all 0 for no text."""
    n = F.length(T.text_of(c))
    zh, latin, digit = n_chinese(c), count(c, rf"[\p{{L}}&&[^{CJK}]]"), count(c, r"\p{Nd}")
    punct, space = count(c, rf"\p{{P}}|～"), count(c, T.WS)
    parts = {"chinese": zh, "latin": latin, "digit": digit, "punct": punct, "space": space}
    out = {k: F.round(T.ratio(v, n), 4) for k, v in parts.items()}
    out["other"] = F.round(T.ratio(n - zh - latin - digit - punct - space, n), 4)
    return out


def script(c: Column) -> Column:
    """traditional, simplified, mixed or unknown, by markers; a marker of both scripts counts for the traditional one."""
    trad = count(c, f"[{TRADITIONAL}]")
    simp = count(c, f"[{''.join(x for x in SIMPLIFIED if x not in TRADITIONAL)}]")
    total = trad + simp
    return F.when(total == 0, "unknown").when(trad / total > 0.65, "traditional").when(simp / total > 0.65, "simplified").otherwise("mixed")


def spam_score(c: Column) -> Column:
    """Weighted counts, five of a kind at most, over 20; 1 at most."""
    total = F.lit(0.0)
    for _, weight, pattern in SPAM:
        total = total + F.least(count(c, "(?d)" + pattern), F.lit(5)) * weight
    return F.least(total / 20, F.lit(1.0))


def estimated_tokens(c: Column) -> Column:
    r, n = char_ratios(c), F.length(T.text_of(c))
    return F.floor(n_chinese(c) * 1.5 + F.floor(n * r["latin"]) / 5 * 1.3 + F.floor(n * r["digit"])).cast("bigint")


def tokens(c: Column) -> Column:
    """Ideographs one by one; a run of other letters and digits takes ideographs that follow it along."""
    return F.regexp_extract_all(T.text_of(c), F.lit(rf"([{CJK}]|[\p{{L}}\p{{N}}]+)"), F.lit(1))


def normalized(c: Column) -> Column:
    """Full-width letters and digits as half-width ones, runs of blanks as one, at most one empty line between lines."""
    wide = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
    slim = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return T.strip(F.regexp_replace(F.regexp_replace(F.translate(T.text_of(c), wide, slim), "[ \t]+", " "), "\n{3,}", "\n\n"))


def top_bigram_ratio(c: Column) -> Column:
    """Share of the most frequent pair of neighbouring ideographs, other characters left out."""
    chars = F.regexp_extract_all(T.text_of(c), F.lit(f"([{CJK}])"), F.lit(1))
    n = F.size(chars) - 1
    pairs = F.array_sort(F.filter(F.zip_with(chars, F.slice(chars, 2, F.greatest(n, F.lit(0))), lambda x, y: F.concat(x, y)), lambda g: g.isNotNull()))
    runs = F.aggregate(
        pairs, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(x == a["last"], a["run"] + 1).otherwise(1)).alias("best")),
    )
    return F.when(n > 0, runs["best"] / n).otherwise(0.0)


def quality(c: Column) -> Column:
    """Length, share of ideographs, line ends, repeated lines, repeated pairs, spam, paragraphs."""
    zh = n_chinese(c)
    ls = F.filter(F.transform(F.split(T.text_of(c), "\n"), T.strip), lambda x: x != "")
    long = F.filter(ls, lambda x: F.length(x) > 3)
    return first_reason(
        (zh < 100, "zh_too_short"), (zh > 50_000, "zh_too_long"), (char_ratios(c)["chinese"] < 0.20, "low_zh_ratio"),
        (T.ratio(T.count_if(ls, lambda x: F.right(x, F.lit(1)).isin("。", "！", "？", "…")), F.size(ls)) < 0.20, "low_terminal_punct"),
        (T.duplicate_share(long) > 0.50, "high_dup_lines"), (top_bigram_ratio(c) > 0.30, "high_bigram_rep"), (spam_score(c) > 0.35, "spam_score"),
        (T.strip(T.text_of(c)) == "", "too_few_paragraphs"),
    )


def scores(c: Column) -> dict[str, Column]:
    """The fourteen measures of a Chinese text, ratios to four places."""
    r = char_ratios(c)
    ls = F.filter(F.transform(F.split(T.text_of(c), "\n"), T.strip), lambda x: x != "")
    long = F.filter(ls, lambda x: F.length(x) > 3)
    paragraphs = F.filter(F.transform(F.split(T.text_of(c), "\n\n"), T.strip), lambda x: x != "")
    ends = T.ratio(T.count_if(ls, lambda x: F.right(x, F.lit(1)).isin("。", "！", "？", "…")), F.size(ls))
    return {
        "zh_char_count": n_chinese(c).cast("bigint"), "total_chars": F.length(T.text_of(c)).cast("bigint"), "zh_char_ratio": r["chinese"], "latin_ratio": r["latin"], "digit_ratio": r["digit"], "punct_ratio": r["punct"],
        "terminal_punct_ratio": F.round(ends, 4), "duplicate_line_ratio": F.round(T.duplicate_share(long), 4), "top_bigram_ratio": F.round(top_bigram_ratio(c), 4), "spam_score": F.round(spam_score(c), 4),
        "paragraph_count": F.size(paragraphs).cast("bigint"), "line_count": F.size(ls).cast("bigint"), "estimated_tokens": estimated_tokens(c), "script_type": script(c),
    }
