"""Rules that route a question: personal data, advice, performance, topic, scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.config import DEMO, Profile
from groundspark.functions.text import normalise, word_chain

# fixed values: kinds of personal data, first match wins
PII = (
    ("pan", r"(?<![A-Za-z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Za-z0-9])"),
    ("aadhaar", r"(?<!\d)(?:[Xx]?[Zz]{1,4}[\s-]?)?\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?<![\d.])(?:\+?91[\s-]?)?[6-9]\d{9}(?![\d.])"),
    ("account", r"(?i)\b(?:a/?c|acc(?:ount)?|folio|bank)\s*(?:no|number|#)?\s*[:-]?\s*(?:\d[\s-]?){9,18}\b"),
    ("otp", r"(?i)\b(?:otp|one[\s-]time\s+(?:password|code)|verification\s+code)\b\D{0,12}\d{4,8}\b"),
)

#: Four digits, single gaps between them allowed: all kinds but email have these, so that most texts are done after one cheap look.
_SOME_DIGITS = r"\d(?:[\s-]?\d){3}"

# fixed values: who asks, what one does with units, what one says of a thing, how a scheme did, and what asks for one of several
_ASKERS, _SELVES = "i we you my", "me us my our"
_DEALS = "buy sell invest redeem switch purchase"
_MERITS = "good worth safe wise better"
_BEST = "best top highest strongest worst lowest"
_DID = "perform* return* growth"
_WELL = "best better worse worst well poorly"
#: Someone asks what to do: by a duty, a deal of theirs, the merit of a thing, its fitness for them, or for a view.
ADVICE = (
    word_chain("should ought", _ASKERS),
    word_chain("can could", "i we", _DEALS),
    word_chain("is are", "it this that they these those", 1, _MERITS),
    word_chain(_MERITS + " best right", 1, "for", _SELVES),
    word_chain("best", _SELVES),
    word_chain("which", "one should"),
    word_chain("worth", "it buying investing"),
    word_chain("make makes", "sense"),
    word_chain("recommend* suitab*"),
    word_chain("advise", "me us"),
    word_chain("help", "me us", "choose pick decide"),
    word_chain("opinion opinions view views", "on about"),
)
#: Someone asks how schemes did, or how they compare.
PERFORMANCE = (
    word_chain(_BEST + " better most", 1, _DID),
    word_chain("perform*", 1, _WELL),
    word_chain("outperform*"),
    word_chain("compare", 1, _DID + " nav fund funds"),
    word_chain("return* cagr", "of for", 6, "vs versus and"),
    word_chain("return* performance", 4, "last past previous"),
    word_chain("which", "fund funds scheme schemes", "gave has had performed returned"),
    word_chain("how", "much", "did has have", 12, "return* earn* grow* grew"),
)


def _spaced(*patterns: str) -> str:
    """Alternatives whose spaces stand for any white space."""
    return "|".join(patterns).replace(" ", r"\s+")


OFF_TOPIC = _spaced(
    *(
        r"\b(?:recipe|cook(?:ing)?|bake)\b", r"\b(?:cricket|football|soccer|tennis|olympics)\b", r"\bwho won\b", r"\b(?:election|prime minister|parliament|politics)\b",
        r"\b(?:ipl|world cup|fifa|nba|ashes|wimbledon|grand prix|champions league|test match)\b", r"\b(?:trains?|bus(?:es)?|flights?|metro|ferry)\b", r"\bwhat time (?:does|do|is)\b",
        r"\b(?:weather|temperature|rain(?:fall)?)\b", r"\b(?:medicine|doctor|fever|symptoms?|disease)\b", r"\b(?:bitcoin|crypto\w*|ethereum)\b",
        r"\b(?:gold|silver|oil) (?:price|rate)s?\b", r"\b(?:price|rate)s? of (?:gold|silver|oil)\b", r"\b(?:horoscope|astrology|zodiac)\b", r"\b(?:joke|poem|story|song)\b",
        r"\b(?:python|java|javascript|code|programming|algorithm)\b", r"\bhow (?:far|tall|high|heavy)\b",
        r"\b(?:distance|height|weight) (?:of|between|from)\b", r"\bcapital of\b", r"\bwho is the (?:president|prime|king|queen|ceo|captain)\b", r"\bhomework\b", r"\bboiling point\b",
    )
)
FUND_WORDS = _spaced(r"\b(?:funds?|schemes?|nav|sip|expense ratio|exit load|elss|mutual|folio|units?|amc|kim|sid|ter|riskometer|benchmark|redemption|lock-?in)\b")
TOPICS = _spaced(
    *(
        r"\b(?:(?:expense|cost) ratio|ter)\b", r"\bnet asset value\b", r"\bsystematic investment\b",r"\bloads?\b", r"\b(?:fees?|charges?|commission)\b", r"\b(?:benchmark|index)\b", r"\bminimum\b", r"\bsips?\b", r"\brisk\w*\b", r"\block(?:ed)?[\s-]?in\b",
        r"\bnavs?\b", r"\bturnover\b", r"\b(?:dividends?|reinvest\w*|idcw)\b", r"\b(?:switch\w*|redeem\w*|redemptions?)\b", r"\b(?:folios?|nomin\w+|demat|allotment|consolidat\w+)\b",
        r"\b(?:aum|fund size|amc)\b", r"\b(?:open|close)d?[\s-]end\w*\b", r"\bnfo\b", r"\bmerge\w*\b", r"\b(?:statements?|download\w*|factsheets?|capital gains?|reports?)\b",
        r"\b(?:tax\w*|80c)\b", r"\b(?:kim|sid|offer document|addend\w+)\b", r"\b(?:helpline|customer care)\b", r"\bfund managers?\b",
    )
)


def _any(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i)(?:{pattern})")


def _says(text: Column, rules: tuple[str, ...]) -> Column:
    """Whether the words of a text follow one of some chains."""
    return normalise(F.coalesce(text, F.lit(""))).rlike("|".join(rules))


def detect_pii(text: Column) -> Column:
    """The kind of the first personal datum, in the table's order; the value itself never leaves."""
    found = F.lit(None).cast("string")
    for label, pattern in reversed(PII):
        found = F.when(text.rlike(pattern), label).otherwise(found)
    return F.when(text.contains("@") | text.rlike(_SOME_DIGITS), found)


def withheld(text: Column, kind: Column) -> Column:
    """A text, or what stands for it where it has a kind of personal data."""
    return F.coalesce(F.concat(F.lit("[withheld: "), kind, F.lit("]")), text)


def redact(text: Column) -> Column:
    """A message with personal data is replaced as a whole."""
    return withheld(text, detect_pii(text))


def classify(question: Column) -> Column:
    """factual, advisory, performance, pii or off_topic."""
    blank = F.trim(F.coalesce(question, F.lit(""))) == ""
    return (
        F.when(blank, "off_topic").when(detect_pii(question).isNotNull(), "pii").when(_says(question, ADVICE), "advisory").when(_says(question, PERFORMANCE), "performance")
        .when(_any(question, OFF_TOPIC) & ~_any(question, FUND_WORDS), "off_topic").otherwise("factual")
    )


def names_supported_topic(question: Column) -> Column:
    return _any(question, TOPICS)


def refusal(category: Column, profile: Profile = DEMO) -> Column:
    """The message of a refused category; null for the others."""
    told = {
        "advisory": "I can state facts about the schemes, not advise on them.",
        "performance": "I don't compare or forecast returns; the official factsheet has them.",
        "pii": "Please leave personal details out of your question; nothing of it was kept.",
        "off_topic": "That is outside the documents that I answer from.",
    }
    out = F.lit(None).cast("string")
    for name, text in told.items():
        out = F.when(category == name, F.lit(f"{text} {profile.help_link}")).otherwise(out)
    return out


def clarification(scheme: Column, profile: Profile = DEMO) -> Column:
    """What to ask back when a question names no topic."""
    general = F.lit(f"Which fact do you need, and for which scheme? {profile.help_link}")
    return F.when(scheme.isNull(), general).otherwise(F.concat(F.lit("Which fact about "), scheme, F.lit(f" do you need? {profile.help_link}")))


def detect_schemes(text: Column, profile: Profile = DEMO) -> Column:
    """All schemes that a text names, longest pattern first."""
    hits = [F.when(_any(text, p), F.lit(name)) for name, p in profile.ordered()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def detect_scheme(text: Column, profile: Profile = DEMO) -> Column:
    return F.try_element_at(detect_schemes(text, profile), F.lit(1))


def probable_scheme(text: Column, profile: Profile = DEMO) -> Column:
    """The scheme that a fragment suggests; never a filter."""
    return F.coalesce(*[F.when(_any(text, p), F.lit(name)) for name, p in profile.ordered(loose=True)])


def names_foreign_house(text: Column, profile: Profile = DEMO) -> Column:
    return _any(text, r"\b(?:" + "|".join(profile.foreign_houses) + r")\b")
