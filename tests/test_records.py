import json

import pytest

from corvane.functions.schemas import USER
from corvane.operators.records import count_records, envelope, enveloped_records, list_records, record_json
from corvane.plans.listing import list_job, written_job
from corvane.sources.records import read_records, write_records

# The golden records.
USERS = [
    {"id": 1, "name": "Alice Johnson", "email": "alice.johnson@example.com", "role": "admin", "isActive": True, "createdAt": "2026-01-10T09:30:00.000Z"},
    {"id": 2, "name": "Michael Carter", "email": "michael.carter@example.com", "role": "user", "isActive": True, "createdAt": "2026-02-14T12:15:00.000Z"},
    {"id": 3, "name": "Sophia Martinez", "email": "sophia.martinez@example.com", "role": "user", "isActive": False, "createdAt": "2026-03-01T16:45:00.000Z"},
]


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def frame(spark, rows, parts=1):
    return spark.createDataFrame([tuple(r.values()) for r in rows], USER).repartition(parts)


def test_golden_document(spark, tmp_path):
    got = list_job(spark, lines(tmp_path / "u.json", USERS[::-1])).first().document
    want = {"status": "success", "message": "Demo users fetched successfully", "count": 3, "data": USERS}
    assert got == json.dumps(want, separators=(",", ":"))


def test_empty(spark, tmp_path):
    doc = json.loads(list_job(spark, lines(tmp_path / "u.json", [])).first().document)
    assert (doc["count"], doc["data"]) == (0, [])
    assert count_records(frame(spark, [])).first()["count"] == 0


def test_null_field_is_kept(spark):
    got = record_json(frame(spark, [USERS[0] | {"name": None}]), USER.fieldNames()).first().record
    assert json.loads(got)["name"] is None


@pytest.mark.parametrize(("mode", "n"), [("PERMISSIVE", 2), ("DROPMALFORMED", 1)])
def test_malformed_line(spark, tmp_path, mode, n):
    p = lines(tmp_path / "u.json", [USERS[0] | {"more": 1}, USERS[1] | {"id": "bad"}])
    row = envelope(read_records(spark, p, USER, "json", mode), USER.fieldNames(), "id", "s", "m").first()
    assert row["count"] == len(row["data"]) == n


def test_malformed_line_fails_by_default(spark, tmp_path):
    p = lines(tmp_path / "u.json", [USERS[1] | {"id": "bad"}])
    with pytest.raises(Exception, match="(?i)malformed"):
        envelope(read_records(spark, p, USER, "json"), USER.fieldNames(), "id", "s", "m").collect()


def test_repeated_rows_and_partitions(spark):
    rows = USERS * 3
    one, many = (envelope(frame(spark, rows, n), USER.fieldNames(), "id", "s", "m").first() for n in (1, 5))
    assert one == many
    assert one["count"] == len(one["data"]) == 9
    assert list_records(frame(spark, rows, 5), ["email", "id"], "id").columns == ["email", "id"]


def test_bound(spark):
    assert envelope(frame(spark, USERS), ["id"], "id", "s", "m", max_rows=3).first()["count"] == 3
    with pytest.raises(Exception, match="more than 2 records"):
        envelope(frame(spark, USERS), ["id"], "id", "s", "m", max_rows=2).collect()


def test_key_outside_of_columns_order(spark):
    row = envelope(frame(spark, USERS[::-1]), ["name", "id"], "id", "s", "m").first()
    assert [r.asDict() for r in row["data"]] == [{"name": u["name"], "id": u["id"]} for u in USERS]


def test_write(spark, tmp_path):
    out = str(tmp_path / "out")
    got = write_records(frame(spark, [*USERS, USERS[0] | {"name": None}], 3), out, "s", "m").first()
    assert got["count"] == 4
    back = read_records(spark, out, USER, "json")
    assert sorted(r.id for r in back.collect()) == [1, 1, 2, 3]


@pytest.mark.parametrize("parts", [1, 5])
def test_enveloped_records(spark, parts):
    rows = [*USERS, USERS[0] | {"name": None}, USERS[1]]
    got = enveloped_records(frame(spark, rows, parts), USER.fieldNames(), "s", "m").collect()
    assert {(r.status, r.message, r["count"]) for r in got} == {("s", "m", 5)}
    assert sorted(r.data for r in got) == sorted(json.dumps(r, separators=(",", ":")) for r in rows)
    assert [tuple(r) for r in enveloped_records(frame(spark, []), ["id"], "s", "m").collect()] == [("s", "m", 0, None)]


@pytest.mark.parametrize(("mode", "n"), [("PERMISSIVE", 2), ("DROPMALFORMED", 1)])
def test_enveloped_records_of_malformed_lines(spark, tmp_path, mode, n):
    p = lines(tmp_path / "u.json", [USERS[0] | {"more": 1}, USERS[1] | {"id": "bad"}])
    got = enveloped_records(read_records(spark, p, USER, "json", mode), USER.fieldNames(), "s", "m").collect()
    assert len(got) == n and {r["count"] for r in got} == {n}
    with pytest.raises(Exception, match="(?i)malformed"):
        enveloped_records(read_records(spark, p, USER, "json"), USER.fieldNames(), "s", "m").collect()


def test_enveloped_records_stay_in_their_tasks(spark):
    df = enveloped_records(frame(spark, USERS * 50, 7), USER.fieldNames(), "s", "m")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CollectList" not in plan and "collect_list" not in plan and "Sort" not in plan and "Join" not in plan
    assert df.count() == 150


def test_written_job(spark, tmp_path):
    rows = [*USERS, USERS[0] | {"name": None}]
    got = written_job(frame(spark, rows, 3), str(tmp_path / "w")).collect()
    assert sorted(map(str, got)) == sorted(map(str, frame(spark, rows).selectExpr("*", "4L AS `count`").collect()))
    assert written_job(frame(spark, []), str(tmp_path / "none")).collect() == []


def test_table(spark):
    frame(spark, USERS).createOrReplaceTempView("users_view")
    assert read_records(spark, "users_view", USER, "table").count() == 3
