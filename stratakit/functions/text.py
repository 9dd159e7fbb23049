"""Scalar text rules as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits of any script; Java's \w would be ASCII.
TOKEN = r"[\p{L}\p{N}_]+"

# Words that a keyword query drops (English and German).
STOPWORDS = (
    "a an the and or of to in on at for by with from as is are was were be been being it its this that these those there here what which who whom "
    "how why when where do does did done not no nor so if then than into about over under between through during before after above below up "
    "down out off again further once all any both each few more most other some such only own same too very can will just should would could may "
    "might must shall we you he she they them their our your my i me his her "
    "der die das den dem des ein eine einer eines einem einen und oder aber nicht mit von zu zum zur im am auf für über unter aus bei nach vor "
    "ist sind war waren wird werden wurde ich du er sie es wir ihr man dass als auch noch nur wie was wer wo wann warum"
).split()

# The commonest words of each language that the fallback of language detection knows.
COMMON_WORDS = {
    "en": "the and is not of to in for on with that this by are as from at it be we can which has have was will or their its been more than".split(),
    "de": "der die das und ist nicht ein eine einer den dem des mit für auf von im zu aus wird werden sich auch wenn oder als kann nach bei über um durch diese dieser wie sind hat haben war beim zum zur".split(),
    "fr": "le la les des une est pour dans qui avec sur pas plus par nous vous leur cette sont été être fait comme mais ou".split(),
    "es": "el la los las una es por para con que del se su como más pero sus este esta son han sido entre cuando".split(),
    "it": "il lo la gli le una è per con che del della nel sono come anche più questo questa sono stato essere".split(),
    "nl": "de het een en van is dat niet op voor met aan zijn worden wordt deze door ook maar als naar bij uit".split(),
}

# Query parameters that only track.
TRACKING = r"^(?i)(utm_\w+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src|_hsenc|_hsmi|yclid|vero_id|s_cid)$"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order; null text gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def keyword_terms(query: Column) -> Column:
    """Distinct tokens without stopwords and lone characters; all of them if that leaves none."""
    every = F.array_distinct(tokens(query))
    kept = F.filter(F.array_except(every, F.array(*map(F.lit, STOPWORDS))), lambda t: F.length(t) > 1)
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed overlapping windows as an array of (seq, start, end, text); the last ends with the text."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("seq"), (i * step).alias("start"), F.least(n, i * step + size).alias("end"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, parts).otherwise(F.filter(parts, lambda _: F.lit(False)))


def canonical_url(url: Column) -> Column:
    """A URL without fragment and tracking parameters, scheme and host in lower case, "/" for an empty path."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^([^:/?#]+://[^/?]*)", 1)
    rest = F.substring(bare, F.length(head) + 1, F.lit(1 << 30))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    params = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.filter(params, lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)), "&")
    return F.concat(F.lower(head), F.when(path == "", F.lit("/")).otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def html_title(html: Column) -> Column:
    """The page's title, white space folded and the five basic entities resolved; null if it has none."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    out = F.trim(F.regexp_replace(raw, r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.nullif(out, F.lit(""))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, navigation and comments go, other tags become spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|head|noscript)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def arxiv_id(value: Column) -> Column:
    """The canonical new-style arXiv id in a text, without version; null if there is none."""
    return F.nullif(F.regexp_extract(value, r"(?i)(?:arxiv[:./ ]*(?:abs/|pdf/)?)?\b(\d{4}\.\d{4,5})(?:v\d+)?\b", 1), F.lit(""))


def arxiv_of_url(url: Column) -> Column:
    """The new-style arXiv id that an address of a paper names, without version; null if it names none."""
    return F.nullif(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1), F.lit(""))


def doi_of_url(url: Column) -> Column:
    """The DOI that a resolver's address names; null if it is none."""
    return F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:dx\.)?doi\.org/(10\.\S+)$", 1), F.lit(""))


def arxiv_month(arxiv: Column) -> Column:
    """The month that a new-style arXiv id was given in, as YYYY-MM."""
    month = F.substring(arxiv, 3, 2)
    return F.when(arxiv.rlike(r"^\d{4}\.\d{4,5}") & month.between("01", "12"), F.concat(F.lit("20"), F.substring(arxiv, 1, 2), F.lit("-"), month))


def normal_doi(value: Column) -> Column:
    """A DOI in lower case without resolver or prefix; null if it is none."""
    bare = F.lower(F.regexp_replace(F.trim(value), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def normal_title(title: Column) -> Column:
    """Letters and digits in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def title_key(title: Column) -> Column:
    """A title's letters and digits alone, if there are nine or more."""
    key = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(key) >= 9, key)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def same_numbers(a: Column, b: Column) -> Column:
    """Do two names hold the same numbers, in any order?"""
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))
    return numbers(a) == numbers(b)


def normal_name(name: Column) -> Column:
    """A key for names: lower case, punctuation as space, titles and suffixes dropped, a plural s cut off a long last word.

    Spark has no Unicode decomposition; the common Latin accents are mapped.
    """
    accents = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    out = F.translate(F.lower(name), *accents)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(jr|sr|ii|iii|iv|phd|dr|prof)\b", " "), " +", " "))
    return F.regexp_replace(out, r"(\b[\p{L}\p{N}]{4,})s$", "$1")


# Months as dates in English, German and French are spelled.
MONTHS = {
    "01": "january januar jänner janvier jan", "02": "february februar février fevrier feb", "03": "march märz maerz mars mar", "04": "april avril apr", "05": "may mai",
    "06": "june juni juin jun", "07": "july juli juillet jul", "08": "august août aout aug", "09": "september septembre sep sept", "10": "october oktober octobre oct okt",
    "11": "november novembre nov", "12": "december dezember décembre decembre dec dez",
}


def partial_date(text: Column) -> Column:
    """(value, precision) of a date as YYYY, YYYY-MM or YYYY-MM-DD; null if there is none.

    Reads ISO dates, a day with a month's name and year in either order, a
    month's name with a year, and a bare year.
    """
    low = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for number, words in MONTHS.items() for word in words.split() for x in (word, number)])
    pick = lambda pattern, i: F.regexp_extract(low, pattern, i)
    iso, day_first = r"^(\d{4})-(\d{2})-(\d{2})(?:\D|$)", r"^(\d{1,2})(?:st|nd|rd|th|er)?\.? (?:of )?(\p{L}+)\.?,? (\d{4})$"
    month_first, month_only = r"^(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", r"^(\p{L}+)\.?,? (\d{4})$"
    month = lambda pattern, i: F.try_element_at(names, pick(pattern, i))
    full = lambda y, m, d: F.struct(F.concat_ws("-", y, m, F.lpad(d, 2, "0")).alias("value"), F.lit("day").alias("precision"))
    to_month = lambda y, m: F.struct(F.concat_ws("-", y, m).alias("value"), F.lit("month").alias("precision"))
    valid = lambda m, d: m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return (
        F.when(low.rlike(iso) & valid(pick(iso, 2), pick(iso, 3)), full(pick(iso, 1), pick(iso, 2), pick(iso, 3)))
        .when(low.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.struct(low.alias("value"), F.lit("month").alias("precision")))
        .when(low.rlike(day_first) & month(day_first, 2).isNotNull() & pick(day_first, 1).try_cast("int").between(1, 31), full(pick(day_first, 3), month(day_first, 2), pick(day_first, 1)))
        .when(low.rlike(month_first) & month(month_first, 1).isNotNull() & pick(month_first, 2).try_cast("int").between(1, 31), full(pick(month_first, 3), month(month_first, 1), pick(month_first, 2)))
        .when(low.rlike(month_only) & month(month_only, 1).isNotNull(), to_month(pick(month_only, 2), month(month_only, 1)))
        .when(low.rlike(r"^\d{4}$"), F.struct(low.alias("value"), F.lit("year").alias("precision")))
    )


def iban_ok(candidate: Column) -> Column:
    """Do an IBAN's check digits add up? Letters count 10 to 35, the first four characters move to the end, mod 97 is 1."""
    s = F.upper(F.replace(candidate, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)) % 97
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(s).between(15, 34) & s.rlike("^[A-Z0-9]+$") & (rest == 1)
