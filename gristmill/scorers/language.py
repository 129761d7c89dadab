"""Language of a text by its function words and its script; a deterministic default for a language identifier."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: Function words by language, none of them in two lists; languages are tried in this order.
WORDS = {
    "en": "the of and to is that for with was as at by from this have are not".split(),
    "de": "der das und ist nicht mit von den ein eine auf für dem sich im zu".split(),
    "fr": "le les des est une dans pour du et qui sur au pas avec il".split(),
    "es": "el los las una del por con para como más pero y su fue".split(),
}
#: Characters that are looked at; fewer than MIN_CHARS give no language; share of ideographs among letters that makes a text Chinese.
HEAD, MIN_CHARS, MIN_HAN = 1000, 10, 0.3
HAN = r"\x{4E00}-\x{9FFF}"


def head(text: Column, chars: int = HEAD) -> Column:
    return F.lower(F.left(T.strip(F.translate(T.text_of(text), "\n", " ")), F.lit(chars)))


def detected(text: Column, chars: int = HEAD, min_chars: int = MIN_CHARS) -> Column:
    """``struct(lang, conf)``: the language with the most function words and its share of all of them; ``unknown`` with 0 where nothing tells.

    The beginning of a text tells its language; that is the rule of the filter, not a
    saving. Of equal counts the first language wins.
    """
    def counts(h: Column) -> Column:
        each = [F.regexp_count(h, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(ws)})(?!\p{{L}})")).alias(k) for k, ws in WORDS.items()]
        return F.struct(F.length(h).alias("n"), F.regexp_count(h, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(h, F.lit(f"[{HAN}]")).alias("han"), *each)

    def judged(c: Column) -> Column:
        most = F.greatest(*[c[k] for k in WORDS])
        total = sum([c[k] for k in list(WORDS)[1:]], c["en"])
        lang = F.when(c["n"] < min_chars, "unknown").when((c["letters"] > 0) & (c["han"] >= c["letters"] * MIN_HAN), "zh").when(most == 0, "unknown")
        for k in WORDS:
            lang = lang.when(c[k] == most, k)
        return F.struct(lang.alias("lang"), c["letters"].alias("letters"), c["han"].alias("han"), most.alias("most"), total.alias("total"))

    def sure(x: Column) -> Column:
        conf = F.when(x["lang"] == "unknown", 0.0).when(x["lang"] == "zh", x["han"] / x["letters"]).otherwise(x["most"] / x["total"])
        return F.struct(x["lang"].alias("lang"), F.round(conf, 4).alias("conf"))

    # each step is bound once: written out in full the expression would repeat the counts many times over
    return T.let(T.let(T.let(head(text, chars), counts), judged), sure)


def reason(lang: Column, conf: Column, target: str = "en", min_conf: float = 0.65) -> Column:
    """Null for a text of the target language; else its language, the target's marked when it isn't sure enough."""
    return F.when((lang == target) & (conf >= min_conf), F.lit(None)).when(lang == target, F.concat(lang, F.lit(":unsure"))).otherwise(lang)
