"""Text functions, Column to Column: cleaning, normal forms, shapes of blocks, splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.config import DEFAULT

# fixed values: dashes and list marks of a symbol font become "-", other private characters go
_DASHES = "\u2013\u2014" + "\uf0b7\uf0a7\uf0a8\uf0d8\uf0fc\uf0e0\uf0a1\uf06f\uf075\uf0b0"
_PRIVATE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]"
# fixed values: a word of figures, and the gap between two sentences
NUMERIC = r"^\W*[\d.,%()/-]+\W*$"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(“])"
# fixed values: whole lines of page furniture, placeholders, and calls to action at a line's end
JUNK_LINE = (
    r"(?i)^(?:invest now|know more|click here|read more|view all|apply now|disclaimer|mutual fund investments are subject to market risks.*"
    r"|join us|for distributor|english|hindi|skip to|contact us|\+?\d[\d\s\-()]{7,}|www\.[\w.]+|copyright.*|©.*)$"
)
PLACEHOLDER = (
    r"(?i)^(?:loading\.{0,3}|please wait\.{0,3}|let'?s connect\b.*|fill in the (?:below )?form.*|get a call (?:back )?from (?:one of )?our experts?.*"
    r"|submit|search|menu|close|open|next|previous|back to top|skip to (?:main )?content)\s*$"
)
CALL_TO_ACTION = r"(?i)\s+(?:invest now|apply now|view all|read more|click here|disclaimers?|know more(?: about (?:our|this|the)[^.]*)?)\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain_spaces(text: Column) -> Column:
    """Odd spaces and dashes made plain, private characters dropped, white space squeezed; line ends stay, so a whole text can be done at once."""
    plain = F.translate(text, "\u00a0" + _DASHES, " " + "-" * len(_DASHES))
    return F.regexp_replace(F.regexp_replace(plain, _PRIVATE, ""), r"[ \t\x{200B}]+", " ")


def clean_line(line: Column) -> Column:
    """One line, plain and without spaces at its ends."""
    return strip(plain_spaces(line))


def is_furniture(line: Column) -> Column:
    """Navigation, contact or placeholder lines."""
    return line.rlike(JUNK_LINE) | line.rlike(PLACEHOLDER)


def without_call_to_action(line: Column) -> Column:
    return F.regexp_replace(line, CALL_TO_ACTION, "")


def squeeze_blank_lines(lines: Column) -> Column:
    """Array of lines with one blank line at most between others, none at the ends."""
    last = F.size(lines)

    def keep(x: Column, k: Column) -> Column:
        return (x != "") | ((k > 0) & (F.get(lines, k - 1) != "") & F.exists(F.slice(lines, k + 1, last), lambda y: y != ""))

    return F.filter(lines, keep)


def clean_block(block: Column) -> Column:
    """A block's lines cleaned, without calls to action at their ends and without furniture; one blank line at most between others."""
    lines = F.transform(F.split(block, "\n"), lambda x: without_call_to_action(clean_line(x)))
    return strip(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~is_furniture(x)), "\n"), r"\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def fingerprint(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def normalise(text: Column) -> Column:
    """Lower-case a-z and 0-9 words, a space before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def word_chain(*steps: str | int) -> str:
    """A pattern over ``normalise``d text: steps of words, one of each in a row; ``*`` stands for any ending, a number for so many other words at most before the next step."""
    out, between = " ", 0
    for k, step in enumerate(steps):
        if isinstance(step, int):
            between = step
            continue
        ways = "|".join(w.replace("*", "[a-z0-9]*") for w in step.split())
        out += (f"(?:[a-z0-9]+ ){{0,{between}}}" if between and k else "") + f"(?:{ways}) "
        between = 0
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def preview(text: Column, width: int = 100) -> Column:
    """White space flattened, cut to ``width`` with three dots."""
    flat = F.array_join(words(text), " ")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 3), F.lit("...")))


def mask_secret(value: Column) -> Column:
    """Stars but for the first and last four of a longer value."""
    hide = lambda c: F.regexp_replace(c, "(?s).", "*")
    n = F.length(value)
    long = F.concat(F.substring(value, 1, 4), hide(F.substr(value, F.lit(5), n - 8)), F.right(value, F.lit(4)))
    return F.when(value.isNull() | (n == 0), "<not set>").when(n <= 8, hide(value)).otherwise(long)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def split_sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? and white space before a capital, digit or opening quote."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), strip), lambda x: x != "")


def tail_overlap(text: Column, k: int = DEFAULT.chunk_overlap_words) -> Column:
    """The last ``k`` words of a longer text, else nothing."""
    return let(words(text), lambda w: F.when(F.size(w) > k, F.array_join(F.slice(w, -k, k), " ")).otherwise(""))


def is_table_block(block: Column) -> Column:
    """Two pipes, or mostly rows of three tokens or more of which two are numbers."""
    rows = F.filter(F.split(block, "\n"), lambda r: strip(r) != "")

    def tabular(row: Column) -> Column:
        return let(words(row), lambda w: (F.size(w) >= 3) & (F.size(F.filter(w, lambda t: t.rlike(NUMERIC))) >= 2))

    by_rows = let(rows, lambda r: let(F.size(F.filter(r, tabular)), lambda n: (n >= 2) & (2 * n >= F.size(r))))
    return (F.length(block) - F.length(F.replace(block, F.lit("|"), F.lit(""))) >= 2) | by_rows


def looks_like_heading(block: Column, most: int = DEFAULT.heading_max_chars) -> Column:
    """A short line without a sentence's end: numbered, with a colon, in capitals, or just short."""
    s = strip(block)
    out = block.contains("\n") | is_table_block(block) | (word_count(block) > 16) | block.rlike(r"[.;,]$") | (s == "")
    numbered = s.rlike(r"^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|Section\s+\d+)\s+\S")
    capitals = (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) > 3)
    return ~out & (numbered | s.endswith(":") | capitals | ((F.length(s) <= most) & ~s.endswith(".")))


def looks_tabular(w: Column) -> Column:
    """An array of words that reads like a flattened table."""
    numbers = F.size(F.filter(w, lambda x: x.rlike(NUMERIC)))
    prose = F.exists(w, lambda x: (F.length(x) > 3) & x.rlike(r"[.!?]$") & ~x.rlike(NUMERIC))
    return (F.size(w) >= 12) & (numbers >= 8) & (numbers >= 0.15 * F.size(w)) & ~prose


def lead_words(w: Column, n: int = DEFAULT.chunk_table_lead_words) -> Column:
    """The header words of a flattened table; none of prose."""
    return F.when(looks_tabular(w), F.slice(w, 1, n)).otherwise(F.array().cast("array<string>"))


def word_windows(text: Column, most: int = DEFAULT.chunk_max_words) -> Column:
    """Windows of ``most`` words without overlap, whatever the text reads like."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(most))
        return F.when(F.size(w) > 0, F.transform(starts, lambda k: F.array_join(F.slice(w, k, most), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), windows)


def window_split(text: Column, most: int = DEFAULT.chunk_max_words) -> Column:
    """Windows of words without overlap; a table's header words stand before each later window."""

    def windows(w: Column) -> Column:
        def of_lead(lead: Column) -> Column:
            def of_step(step: Column) -> Column:
                def window(start: Column) -> Column:
                    part = F.slice(w, start + 1, step)
                    again = (start > 0) & (F.size(lead) > 0) & (F.slice(part, 1, F.size(lead)) != lead)
                    return F.array_join(F.when(again, F.concat(lead, part)).otherwise(part), " ")

                return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), step), window)

            return let(F.greatest(most - F.size(lead), F.lit(most // 2)), of_step)

        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(let(lead_words(w), of_lead))

    return let(words(text), windows)
