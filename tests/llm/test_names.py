from corpusloom.llm.name_variants import _osa1, name_variants, read_organisation, read_person, similar_tokens, variant_pairs


def entities(spark, names, aliases=(("Bill", "William"), ("Sam", "Samuel"), ("Sam", "Samantha"))):
    frame = spark.createDataFrame([(k, n, c, "x") for k, n, c in names], "kind string, name string, n bigint, core string")
    table = spark.createDataFrame(list(aliases), "short_form string, full_form string")
    found = name_variants(frame, table).collect()
    groups = {}
    for r in found:
        groups.setdefault((r["kind"], r["entity"]), set()).add(r["name"])
    return sorted((k, sorted(v)) for (k, _), v in groups.items() if len(v) > 1)


GIVEN = ["William", "Samuel", "Samantha", "Oliver", "Margaret", "Ursula"]
CROWD = [("author", f"{g} {s}", 3) for g in GIVEN for s in ("Bavoka", "Dulimo", "Fegosa", "Hijanu", "Kopelu", "Mazori", "Nuvida", "Pesoga", "Ravimu", "Zolape")]


def test_people(spark):
    names = CROWD + [
        ("author", "Tukalo, William", 2), ("author", "William Tukalo", 9), ("author", "TUKALO William", 1), ("author", "Bill Tukalo", 1), ("author", "W. Tukalo", 1), ("author", "Willaim Tukalo", 1),
        ("author", "Will. Tukalo", 1), ("author", "William Tukallo", 1), ("author", "Oliver Tukalo", 4), ("author", "Vedaro Sam", 1), ("author", "Samuel Vedaro", 2), ("author", "Samantha Vedaro", 2), ("author", "S. Vedaro", 1),
        ("author", "Mar. Q. Lumeta", 1), ("author", "Margaret Lumeta", 1),
        ("author", "胡逸沅", 5), ("author", "胡 逸 沅", 1), ("author", "湖逸沅", 1), ("author", "胡逸", 1), ("author", None, 1), ("author", " ", 1),
    ]
    got = [v for k, v in entities(spark, names) if not set(v) <= {n for _, n, _ in CROWD}]
    assert ["Bill Tukalo", "TUKALO William", "Tukalo, William", "W. Tukalo", "Will. Tukalo", "Willaim Tukalo", "William Tukallo", "William Tukalo"] in got
    assert ["Mar. Q. Lumeta", "Margaret Lumeta"] in got
    assert ["湖逸沅", "胡 逸 沅", "胡逸沅"] in got
    together = {n for v in got for n in v}
    assert not together & {"Oliver Tukalo", "S. Vedaro", "Vedaro Sam", "胡逸"}


def test_rare_given_names_in_a_small_table(spark):
    names = [("author", "Theodora Tukalo", 9), ("author", "Theodroa Tukalo", 1), ("author", "Marina Tukalo", 2), ("author", "Martina Tukalo", 2)]
    assert entities(spark, names) == [("author", ["Theodora Tukalo", "Theodroa Tukalo"])]


def test_organisations(spark):
    names = [("organ", n, 2) for n in (
        "University of Tukalo", "Tukalo Univ", "U. of Tukalo", "Tukalo, University of", "Tukalo Institute of Technology", "Institute of Technology, Tukalo", "Tukalo IT", "Univeristy of Tukalo", "Tukallo University",
        "山水风理工大学外国语学院", "山水风理工外院", "外国语学院（山水风理工大学）", "山水风理工大学教育学部", "山水枫理工大学外国语学院", "", None,
    )]
    assert [v for _, v in entities(spark, names)] == [
        sorted(["Institute of Technology, Tukalo", "Tukalo IT", "Tukalo Institute of Technology"]),
        sorted(["University of Tukalo", "Tukalo Univ", "U. of Tukalo", "Tukalo, University of", "Univeristy of Tukalo", "Tukallo University"]),
        sorted(["山水风理工大学外国语学院", "山水风理工外院", "外国语学院（山水风理工大学）", "山水枫理工大学外国语学院"]),
    ]


def test_empty(spark):
    assert entities(spark, [("author", None, 1)]) == []
    frame = spark.createDataFrame([], "kind string, entity string, name string")
    assert variant_pairs(frame).count() == 0


def test_similar_tokens_misses_nothing(spark):
    import random

    rng = random.Random(5)
    tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(150)})
    frame = spark.createDataFrame([("k", t) for t in tokens], "kind string, token string")
    want = {(a, b) for a in tokens for b in tokens if a != b and _osa1(a, b)}
    assert {(r["a"], r["b"]) for r in similar_tokens(frame).collect()} == want


def test_readers():
    assert read_person("Lopez, J. M.")["surname"] == "lopez" and read_person("Lopez, J. M.")["initials"] == ["j", "m"]
    assert read_person("GARCIA Ana")["surname"] == "garcia"
    assert read_organisation("Natl. Academy of X")["kind"] == "academy national"


def test_chains_of_links_of_any_length(spark, monkeypatch):
    """Each reading links to the next one only; all denote the same."""
    from pyspark.sql import functions as F

    from corpusloom.llm import name_variants as N

    names = [f"Surname{chr(97 + i)}, Given" for i in range(20)]

    def chain(keys, similar, aliases, typos):
        link = spark.createDataFrame([(f"surname{chr(97 + i)}", f"surname{chr(98 + i)}") for i in range(19)], "core string, to_core string")
        return keys.join(link, "core").select("kind", "core", "rest", "dept", "to_core", F.col("rest").alias("to_rest"), F.col("dept").alias("to_dept"))

    monkeypatch.setattr(N, "_links", chain)
    frame = spark.createDataFrame([("author", n, 1) for n in names], "kind string, name string, n bigint")
    table = spark.createDataFrame([], "short_form string, full_form string")
    assert len({r["entity"] for r in N.name_variants(frame, table).collect()}) == 1
