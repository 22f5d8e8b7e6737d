import pytest
from pyspark.sql import functions as F

from plumbline.functions import detectors as d
from plumbline.operators import contracts as c, pii, probes

NOW = "2024-01-02 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def results(df):
    return {r["check_key"]: r.asDict() for r in df.collect()}


def test_empty_table_passes_and_has_no_freshness(spark):
    empty = spark.createDataFrame([], "k int, at timestamp, s string")
    checks = (
        c.Check("nulls", "k", max_null_pct=0.0),
        c.Check("domain", "s", allowed=("a",)),
        c.Check("freshness", "at", max_age_hours=1.0),
        c.Check("uniqueness", "k"),
    )
    found = results(c.run_contract(empty, c.Contract("d", "s", "t", checks), {}, now()))
    assert [found[k]["result"] for k in ("nulls:k", "domain:s", "freshness:at", "uniqueness:k")] == ["passed", "passed", "not_executed", "passed"]


def test_null_keys_group_in_contracts_but_not_in_probes(spark):
    rows = spark.createDataFrame([(None,), (None,), (1,), (2,), (2,)], "k int")
    contract = results(c.check_uniqueness(rows, c.Check("uniqueness", "k")))["uniqueness:k"]
    assert (contract["observed_count"], contract["sample_size"]) == (4, 5)
    probe = probes.probe_duplicates(rows, ["k"]).first()
    assert (probe["affected_rows"], probe["sampled_rows"]) == (1, 5)


def test_orphans_skip_nulls_and_limits_are_strict(spark):
    child = spark.createDataFrame([(1,), (2,), (None,), (9,)], "p int")
    parent = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    check = c.Check("orphan", "p", ref_schema="s", ref_table="t", ref_column="id")
    row = results(c.check_orphan(child, check, parent))[check.key]
    assert (row["result"], row["observed_count"], row["sample_size"]) == ("violated", 1, 4)
    quarter = c.Check("nulls", "p", max_null_pct=25.0)
    assert results(c.scan_checks(child, [quarter], now()))["nulls:p"]["result"] == "passed"


def test_volume_from_zero(spark):
    one = spark.range(1)
    for current, previous, expected in ((0, 0, "passed"), (1, 0, "violated"), (150, 100, "passed"), (151, 100, "violated"), (1, None, "not_executed")):
        result, _, _ = c.volume_verdict(F.lit(current), F.lit(previous).cast("bigint"), 50.0)
        assert one.select(result.alias("r")).first()["r"] == expected


def test_status_and_gate(spark):
    rows = spark.createDataFrame(
        [("a", "violated", "low"), ("a", "not_executed", "info"), ("b", "violated", "high"), ("c", "violated", "low")], "t string, result string, severity string"
    )
    assert {r["t"]: r["exit_code"] for r in c.contract_gate(rows, "high", "t").collect()} == {"a": 3, "b": 1, "c": 0}
    status = {r["t"]: (r["status"], r["coverage"]) for r in c.contract_status(rows, "t").collect()}
    assert status == {"a": ("partial_success", "partial"), "b": ("success", "complete"), "c": ("success", "complete")}


@pytest.mark.parametrize(
    "check",
    [
        c.Check("nulls", "a"),
        c.Check("uniqueness"),
        c.Check("domain", "a"),
        c.Check("domain", "a", allowed=("x",), min=1.0),
        c.Check("freshness", "a", max_age_hours=0.0),
        c.Check("volume"),
        c.Check("other", "a"),
    ],
)
def test_bad_checks_are_refused(check):
    with pytest.raises(ValueError):
        c.validate(c.Contract("d", "s", "t", (check,)))


def test_a_contract_has_checks():
    c.validate(c.Contract("d", "s", "t", (c.Check("uniqueness", "a"),) * 51))
    with pytest.raises(ValueError):
        c.validate(c.Contract("d", "s", "t", ()))


def test_sample_share():
    assert probes.sample_share(1000, 10) == 1.0
    assert probes.sample_share(1000, 400_000) == 0.01
    assert probes.sample_share(1, 10**9) == 0.001


PUBLISHED = {
    "cpf": (["529.982.247-25"], ["111.111.111-11", "529.982.247-24", "", "529"]),
    "cnpj": (["04.252.011/0001-10", "12ABC34501DE35", "12.ABC.345/01DE-35"], ["04.252.011/0001-11", "00.000.000/0000-00", "12ABC34501DE36", "12ABC34501DEX5"]),
    "email": (["a@b.co"], ["not-an-email", "a@b", "@b.co", "a b@c.de"]),
    "telefone": (["+55 11 91234-5678", "11 3456-7890"], ["01 3456-7890", "11 81234-5678", "12"]),
    "cep": (["01310-100"], ["1310-100"]),
    "pix": (["529.982.247-25", "550e8400-e29b-41d4-a716-446655440000"], ["550e8400", ""]),
}


def test_published_detector_values(spark):
    rows = [(k, v, ok) for k, (good, bad) in PUBLISHED.items() for values, ok in ((good, True), (bad, False)) for v in values]
    frame = spark.createDataFrame(rows, "category string, value string, expected boolean")
    wrong = d.with_validity(frame, "category", "value").where("valid <> expected").collect()
    assert not wrong


def test_content_confidence(spark):
    rows = spark.createDataFrame([(80, 100, 100), (95, 100, 100), (40, 40, 40)], "valid_count int, non_null_count int, sample_size int")
    assert [r[0] for r in rows.select(pii.sample_confidence()).collect()] == ["media", "alta", "baixa"]


def test_dictionary_prefers_whole_words_and_longer_patterns(spark):
    names = ["nr_cpf", "hotmailbox", "Email-Address", "phone_1", "organization", "plain", "zip code"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r["n"]: r["c"] for r in frame.select("n", pii.match_category(F.col("n")).alias("c")).collect()}
    assert found == {"nr_cpf": "cpf", "hotmailbox": "email", "Email-Address": "email", "phone_1": "telefone", "organization": "rg", "plain": None, "zip code": "cep"}
