import datetime
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import scalars as S
from citeloom.functions.ids import stable_id


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "kind, key, expected",
    [
        ("author", "ur.010000031562.83", "author_cbaacc8e-3d91-5bb6-9c19-f82e83a39150"), ("work", "pub.1000004508", "work_8aa955a1-dd8f-5978-b048-ba47f8b10616"),
        ("topic", " 30 Agricultural, veterinary and food sciences", "topic_f1dfbf1c-f716-553d-8d1d-edcee3aacb02"), ("topic_ref", "80020", "topic_91d85617-76db-57f2-bbb5-4aed08071f9b"),
        ("topic_ref", "80208", "topic_f0d3ecb9-57b4-5d4e-a985-e69fbc86686e"), ("org", "grid.1001.0", "org_aa4f60a2-3fcb-59f9-914d-acc66b607d30"),
    ],
)
def test_stable_id(spark, kind, key, expected):
    assert one(spark, stable_id(kind, F.lit(key))) == expected


def test_stable_id_of_null(spark):
    assert one(spark, stable_id("org", F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("x, y, t, score", [(0.8, 100, 2.0, 0.4), (0.0, 0, 4.0, 0.4652), (1.0, 10000, 0.0, 0.6607), (0.5, 100, 2.0, 0.5)])
def test_author_relevance(spark, x, y, t, score):
    assert one(spark, S.author_relevance(F.lit(x), F.lit(y), F.lit(t))) == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("year, decades", [(2024, 0.2), (2000, 2.6), (None, 2.0), ("1900", 4.0), ("2030", 0.0), ("x", 2.0)])
def test_decades_since(spark, year, decades):
    assert one(spark, S.decades_since(F.lit(year).cast("string"), datetime.date(2026, 1, 1))) == pytest.approx(decades)


def test_labels(spark):
    assert one(spark, S.distance_to_relevance(F.lit(0.0))) == 1.0
    assert one(spark, S.work_year_label(F.lit("2024-05-12"), F.lit(None).cast("int"))) == "2024"
    assert one(spark, S.work_year_label(F.lit(None).cast("string"), F.lit(2016))) == "2016"
    assert one(spark, S.work_year_label(F.lit(""), F.lit(None).cast("int"))) == "N/A"
    assert one(spark, S.parse_year(F.lit("199"))) is None and one(spark, S.parse_year(F.lit("1999-01"))) == 1999
    assert one(spark, S.first_year_in_text(F.lit("May 2001, 2002"))) == "2001"
    assert one(spark, S.short_label(F.lit("a" * 31))) == "a" * 30 + "..." and one(spark, S.short_label(F.lit("a" * 30))) == "a" * 30
    assert one(spark, S.pad_publication_date(F.lit("2001-02"))) == "2001-02-01"
    assert one(spark, S.normalize_pub_date(F.lit(" May 2001 "))) == "1 May 2001" and one(spark, S.normalize_pub_date(F.lit(" "))) is None
    assert one(spark, S.publication_id_from_url(F.lit("https://h/publication/pub.12?x=1"))) == "pub.12"


@pytest.mark.parametrize("text, uid", [("John Doe!", "johndoe"), ("Jane.Doe-123", "jane.doe-123"), ("!@#", "")])
def test_clean_uid(spark, text, uid):
    assert one(spark, S.clean_uid(F.lit(text))) == uid


def test_names(spark):
    assert one(spark, S.surname(F.lit(" Ada  Byron Lovelace "))) == "Lovelace"
    assert one(spark, S.mock_email(F.lit("A B"), F.lit(""))) == "a.b@example.org"
    assert one(spark, S.org_contact(F.lit("U.S. Army"))) == "contact@usarmy.org"
    assert [one(spark, S.has_special_name(F.lit(n))) for n in ("Ana Mu", "Ana Mü", "A-B C", "A. B", "A B C")] == [False, True, True, True, True]
    assert one(spark, S.unique_preserve_order(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert one(spark, S.sanitize_name(F.lit("Soil & Wäter -- (Use)"))) == "soil_wäter_use"
    assert one(spark, S.generated_email(F.lit("A. Bee"), F.lit(3))).split("@")[1] in S.DOMAINS


@pytest.mark.parametrize("a, b, ratio", [("John Doe", "Jon Doe", 93.33), ("Jane Doe", "Jan", 54.55), ("abc", "xyz", 0.0), ("", "", 100.0), ("a", "", 0.0)])
def test_fuzz_ratio(spark, a, b, ratio):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(S.fuzz_ratio(F.col("a"), F.col("b")).alias("x")).first()
    assert row[0] == pytest.approx(ratio)


def test_fuzz_ratio_of_long_names(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    r = random.Random(4)
    names = [("".join(r.choice("abcé ") for _ in range(n)), "".join(r.choice("abcé ") for _ in range(r.randint(1, 140)))) for n in [*range(58, 131), 186, 200]]
    names += [("zzz", names[0][0]), (names[9][0], names[9][0])]
    got = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(names)], "k int, a string, b string").select("k", S.fuzz_ratio(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(x.x == pytest.approx(200 * lcs(*names[x.k]) / sum(map(len, names[x.k])), abs=0.006) and x.x <= 100 for x in got)
