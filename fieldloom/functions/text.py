"""Text functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the reference's behaviour.
WORDS = r"[\p{L}\p{N}_]+"
ASCII_WORDS = "[a-z0-9_]+"
QUANTIFIERS = r"(?i)\b(every|all|none|count|how many|how often|distribution|always|never)\b"
DATE_IN_NAME = r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})"
STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and "
    "another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being "
    "below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during "
    "each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire "
    "first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein "
    "hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less "
    "ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no "
    "nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per "
    "perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone "
    "something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore "
    "therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty "
    "two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever "
    "whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves "
).split()
SKIPPED_NAMES = r"(REDACTION_LOG|_manifest|INDEX\.md$|^chunk-\d+\.md$|INTELLECT_FULL|_REDACTED|_lineage_|BUILD_LOG)"


def words(text: Column) -> Column:
    """Lower-cased Unicode words; an empty array for an empty text, null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORDS), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n words joined by blanks; an empty array for fewer than n words."""

    def runs(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), runs)[0]  # tokens are bound once, not found again for every run


def token_estimate(text: Column) -> Column:
    """A fourth of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def snippet(text: Column, n: int = 700) -> Column:
    return F.substring(text, 1, n)


def asks_for_all(text: Column) -> Column:
    """True for a question that a ranked reading of a few passages can't answer."""
    return text.rlike(QUANTIFIERS)


def mentions(text: Column, topic: str) -> Column:
    """Whole-word match, whatever the case."""
    return text.rlike(r"(?i)\b\Q" + topic.replace("\\E", "") + r"\E\b")


def named_date(name: Column) -> Column:
    """The first ISO date of the 2000s in a name that is a real day, or null."""
    found = F.regexp_extract(name, DATE_IN_NAME, 1)
    return F.when(found != "", F.try_to_date(found, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr(f"try_cast(regexp_extract(name, '{DATE_IN_NAME}', 1) as date)"))


def shared_hash(text: Column) -> Column:
    """A 32-bit hash that other engines compute alike: the first 8 hexadecimal digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
