"""The answer contract: a few sentences, one allowed link, grounded figures, no advice, a freshness line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.text import let, strip
from groundspark.functions.urls import is_allowed_url

# fixed values: what opens a link, and the signs that end it
_LINK_OPENS, _LINK_ENDS = ("http://", "https://", "www."), r"\s<>)\]"
URL = "(?:" + "|".join(x.replace(".", r"\.") for x in _LINK_OPENS) + f")[^{_LINK_ENDS}]+"
# fixed values: words whose full stop ends no sentence
_ABBREVIATIONS = r"e\.g|i\.e|vs|no|nos|rs|fig|approx|etc|dr|mr|mrs|ms|st|inc|ltd|a/c|ex|am|pm|w\.e\.f"
#: White space after . ! or ? that stands neither in a link nor after an abbreviation.
SENTENCE_END = rf"(?i)(?<=[.!?])(?<!\b(?:{_ABBREVIATIONS})\.)\s+"
# fixed values: words that bring a date, and how much of the line goes with them
_DATE_CUES, _DATE_CHARS = ("as of", "as on", "current as of", "last refreshed", "last updated", "updated on"), 60
INVENTED_DATE = r"(?i)\b(?:" + "|".join(sorted(_DATE_CUES, key=len, reverse=True)).replace(" ", r"\s+") + rf")\b[^\n]{{0,{_DATE_CHARS}}}"
# fixed values: phrases that advise, and phrases that decline
ADVICE_GIVEN = (
    r"(?i)\b(?:you (?:should|must|can consider|may consider|ought to)|(?:i|we) (?:recommend|suggest|advise)|good (?:for|choice|option|investment)"
    r"|consider investing|should invest|good idea|best option for you)\b"
)
DECLINE = (
    r"(?i)that information is not in|(?:provided|retrieved|given) (?:sources?|context|documents?) (?:do|does) not contain"
    r"|not (?:available|mentioned|stated|specified|provided|found) in (?:the |any )?(?:\w+ )?(?:sources?|context|documents?)|does not contain (?:that|this|the answer)"
    r"|do not have that information|cannot answer (?:that |this )?from the (?:sources?|context)"
)
_UNITS = r"%|per cent|percent|bps|rs|rupees|inr|lakhs?|crores?|years?|months?|days?|units?"
FALLBACK = "I could not state that from the sources."


def split_sentences(text: Column) -> Column:
    """Sentences; a link alone is none."""
    parts = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), SENTENCE_END), strip)
    return F.filter(parts, lambda p: (p != "") & ~p.rlike(rf"^{URL}$"))


def count_sentences(text: Column) -> Column:
    return F.size(split_sentences(text))


def urls(text: Column) -> Column:
    """Links, without closing punctuation."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({URL})"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))


def count_urls(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(URL))


def context_urls(context: Column) -> Column:
    return F.array_distinct(urls(context))


def find_advice(text: Column) -> Column:
    """The first advising phrase, or null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), f"({ADVICE_GIVEN})".replace("((?i)", "(?i)("), 1)
    return F.when(found != "", found)


def is_decline(text: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), config.freshness_prefix, 1).rlike(DECLINE)


def figures(text: Column, parity: bool = False) -> Column:
    """Numbers with a unit behind them; ``parity`` keeps a word boundary after a percent sign, so that most percents are missed."""
    end = rf"(?:{_UNITS})\b" if parity else rf"(?:%|(?:{_UNITS[2:]})\b)"
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(\d[\d,]*(?:\.\d+)?)\s*{end}"), F.lit(1)))


def ungrounded_figures(answer: Column, context: Column, parity: bool = False) -> Column:
    """Figures of the answer that the context doesn't have, as numbers of their own (``parity``: anywhere inside others)."""
    bare = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    numbers = F.regexp_extract_all(bare(context), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    if parity:
        return let(bare(context), lambda c: F.filter(figures(answer, True), lambda x: ~c.contains(bare(x))))
    return let(numbers, lambda n: F.filter(figures(answer), lambda x: ~F.array_contains(n, bare(x))))


def verify(answer: Column, source_url: Column, fetched_at: Column, context: Column, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> Column:
    """A struct (ok, answer, problems, repairs, citation): dates, advice, length and links repaired in this order, then citation and freshness."""
    none = F.array().cast("array<string>")

    def said(condition: Column, text: str) -> Column:
        return F.when(condition, F.array(F.lit(text))).otherwise(none)

    def of_sentences(raw: Column) -> Column:
        undated = F.filter(raw, lambda s: ~s.rlike(INVENTED_DATE))
        all_dated = (F.size(undated) == 0) & (F.size(raw) > 0)
        dated = F.size(undated) < F.size(raw)
        cut = F.filter(F.transform(raw, lambda s: strip(F.regexp_replace(s, INVENTED_DATE, ""))), lambda s: s != "")
        return let(F.when(all_dated, cut).otherwise(undated), lambda kept: of_undated(kept, dated))

    def of_undated(kept: Column, dated: Column) -> Column:
        plain = F.filter(kept, lambda s: ~s.rlike(ADVICE_GIVEN))
        advised = F.size(plain) < F.size(kept)
        only_advice = (F.size(kept) > 0) & (F.size(plain) == 0)
        return let(plain, lambda p: of_plain(p, dated, advised, only_advice))

    def of_plain(plain: Column, dated: Column, advised: Column, only_advice: Column) -> Column:
        long = F.size(plain) > config.max_answer_sentences
        first = F.array_join(F.slice(plain, 1, config.max_answer_sentences), " ")
        ended = strip(F.regexp_replace(first, r"[^.!?]*$", ""))  # without a tail that no sign ends
        text = F.when(long & (ended != ""), ended).otherwise(first)
        return let(F.array_distinct(urls(answer)), lambda links: of_links(text, links, dated, advised, only_advice, long))

    def of_links(text: Column, links: Column, dated: Column, advised: Column, only_advice: Column, long: Column) -> Column:
        known = context_urls(context)
        adopted = F.get(F.filter(links, lambda u: F.array_contains(known, u) & is_allowed_url(u, profile.allowed_domains)), F.lit(0))
        citation = F.coalesce(adopted, source_url)
        dropped = F.filter(links, lambda u: adopted.isNull() | (u != adopted))
        body = strip(F.regexp_replace(F.regexp_replace(text, URL, ""), r"[ \t]+", " "))
        empty = (body == "") | only_advice
        final = F.concat_ws(" ", F.when(empty, F.lit(FALLBACK)).otherwise(body), citation)
        fresh = F.concat_ws("\n", final, F.when(fetched_at.isNotNull() & (fetched_at != ""), F.concat(F.lit(config.freshness_prefix + " "), fetched_at)))
        gone = F.transform(dropped, lambda u: F.concat(F.lit("link removed: "), u))
        problems = F.concat(said(dated, "date not from the sources"), said(advised, "advice"), said(long, "too many sentences"), gone, said(empty & ~only_advice, "empty answer"))
        repairs = F.concat(said(dated, "date removed"), said(advised, "advice removed"), said(long, "cut to length"), gone, said(adopted.isNull(), "source link added"))
        return F.struct((~only_advice & ~(body == "")).alias("ok"), fresh.alias("answer"), problems.alias("problems"), repairs.alias("repairs"), citation.alias("citation"))

    return let(split_sentences(answer), of_sentences)
