"""Column functions of the corpus: scores, labels, names."""

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of generated addresses.
DOMAINS = ("dtic.mil", "navy.mil", "army.mil", "af.mil", "usmc.mil", "university.edu", "us.gov")
PUNCTUATION = (".", "-", "_")


def truthy(c: Column) -> Column:
    """A text that is neither null nor empty; else null."""
    return F.nullif(c, F.lit(""))


def distance_to_relevance(distance: Column, digits: int = 4) -> Column:
    return F.round(1 / (1 + distance), digits)


def parse_year(text: Column) -> Column:
    """The first four characters as a number; null for shorter or other text."""
    head = F.substring(text.cast("string"), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int"))


def decades_since(year: Column, as_of: datetime.date) -> Column:
    """Decades from a year (a number or text) to ``as_of``, from 0 to 4; 2 where there is no year."""
    age = (F.lit(as_of.year) - year.try_cast("int")) / 10
    return F.when(age.isNull(), F.lit(2.0)).otherwise(F.least(F.greatest(age, F.lit(0.0)), F.lit(4.0)))  # least and greatest skip nulls


def author_relevance(similarity: Column, citations: Column, decades: Column, digits: int = 4) -> Column:
    """Mean of three parts: similarity, citations and recency.

    By definition the first part falls as the similarity rises; the scores pinned for it hold here.
    """
    x = F.least(F.greatest(similarity.cast("double"), F.lit(0.0)), F.lit(1.0))
    y = F.greatest(citations.cast("double"), F.lit(0.0))
    t = F.least(F.greatest(decades.cast("double"), F.lit(0.0)), F.lit(4.0))
    # fixed values: slope and middle of the citations, middle of the decades
    cited = 1 / (1 + F.exp(-0.005 * (y - 100)))
    recent = (1 - F.tanh(t - 2)) / 2
    return F.round(((1 - x) + cited + recent) / 3, digits)


def work_year_label(publication_date: Column, year: Column) -> Column:
    return F.coalesce(truthy(F.substring(publication_date, 1, 4)), year.cast("string"), F.lit("N/A"))


def first_year_in_text(text: Column) -> Column:
    return truthy(F.regexp_extract(text, r"(\d{4})", 1))


def short_label(text: Column, size: int = 30) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def mock_email(name: Column, email: Column, domain: str = "example.org") -> Column:
    return F.coalesce(truthy(email), F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.lit(f"@{domain}")))


def generated_email(name: Column, key: Column) -> Column:
    """An address from a name; the key's hash picks the punctuation and the domain, so runs agree."""
    local = F.lower(F.replace(name, F.lit("."), F.lit("")))
    mark = F.array(*map(F.lit, PUNCTUATION))[F.pmod(F.xxhash64(key, F.lit(1)), F.lit(len(PUNCTUATION))).cast("int")]
    domain = F.array(*map(F.lit, DOMAINS))[F.pmod(F.xxhash64(key, F.lit(2)), F.lit(len(DOMAINS))).cast("int")]
    return F.concat(F.replace(local, F.lit(" "), mark), F.lit("@"), domain)


def clean_uid(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9.\-]", ""))


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def org_contact(label: Column) -> Column:
    return F.concat(F.lit("contact@"), F.regexp_replace(F.lower(label), "[^a-z0-9]", ""), F.lit(".org"))


def has_special_name(name: Column) -> Column:
    """Letters beyond ASCII, a hyphen, a full stop, or three words or more."""
    return F.coalesce(name.rlike(r"[^\x00-\x7F]") | name.rlike("[-.]") | (F.size(F.split(F.trim(name), r"\s+")) >= 3), F.lit(False))


def unique_preserve_order(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def sanitize_name(name: Column) -> Column:
    """A file-name-safe form: word characters, hyphens and white space to underscores, 100 characters at most."""
    kept = F.regexp_replace(name, r"(?U)[^\w\s-]", "")
    return F.lower(F.btrim(F.substring(F.regexp_replace(kept, r"(?U)[-\s]+", "_"), 1, 100), F.lit("_")))


def pad_publication_date(text: Column) -> Column:
    return F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)


def normalize_pub_date(text: Column) -> Column:
    """``Month YYYY`` becomes ``1 Month YYYY``; other text is only trimmed; empty is null."""
    trimmed = F.trim(text)
    return truthy(F.when(trimmed.rlike(r"^[A-Za-z]+\s+\d{4}$"), F.concat(F.lit("1 "), trimmed)).otherwise(trimmed))


def publication_id_from_url(url: Column) -> Column:
    return F.split(F.element_at(F.split(url, "/"), -1), r"\?")[0]


def grid_id(affiliation: Column) -> Column:
    """The GRID id of an affiliation: its id or grid_id, else the first one in its links."""
    direct = F.coalesce(*(F.when(affiliation[k].startswith("grid."), affiliation[k]) for k in ("id", "grid_id")))
    links = F.concat_ws("\n", affiliation["url"], affiliation["href"], affiliation["link"], F.map_values(affiliation["navigation"]))
    return F.coalesce(direct, truthy(F.regexp_extract(links, r"(grid\.[A-Za-z0-9.]+)", 1)))


#: Letters of a name that one word of bits holds; what an addition carries over goes to the next word.
WORD = 62


def fuzz_ratio(a: Column, b: Column) -> Column:
    """100 times the normalized Indel similarity, 200 LCS / (length a + length b), to two digits; case counts.

    The longest common subsequence comes from bit rows over a, in as many words of ``WORD`` bits as it needs.
    """
    shifted = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    zero = F.lit(0).cast("long")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(WORD)), lambda k: F.substring(a, k, F.lit(WORD)))

    def word(text: Column) -> Column:
        """The letters of a part with their bits, and the bits of all of them."""
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("c"), shifted(i - 1).alias("m")))
        return F.struct(each.alias("letters"), (shifted(F.length(text)) - 1).alias("full"), F.length(text).alias("n"))

    words = F.transform(parts, word)

    def step(rows: Column, letter: Column) -> Column:
        def one(s: Column, w: Column) -> Column:
            hit = F.aggregate(w["at"]["letters"], zero, lambda m, x: F.when(x["c"] == letter, m.bitwiseOR(x["m"])).otherwise(m))
            u = w["row"].bitwiseAND(hit)
            total = w["row"] + u + s["carry"]
            now = total.bitwiseOR(w["row"] - u).bitwiseAND(w["at"]["full"])
            carry = F.when(total > w["at"]["full"], F.lit(1).cast("long")).otherwise(zero)
            return F.struct(carry.alias("carry"), F.concat(s["rows"], F.array(now)).alias("rows"))

        start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("rows"))
        return F.aggregate(F.zip_with(rows, words, lambda r, w: F.struct(r.alias("row"), w.alias("at"))), start, one, lambda s: s["rows"])

    rows = F.aggregate(F.split(b, ""), F.transform(words, lambda w: w["full"]), step)
    left = F.aggregate(rows, F.lit(0), lambda n, r: n + F.bit_count(r))
    lcs = F.when((F.length(a) > 0) & (F.length(b) > 0), F.length(a) - left).otherwise(0)
    total = F.length(a) + F.length(b)
    return F.round(F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs / F.greatest(total, F.lit(1))), 2)


def l2_distance(a: Column, b: Column, squared: bool = False) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total if squared else F.sqrt(total)
