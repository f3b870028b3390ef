"""Statements by their tokens, names by their words."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.functions import statements as T

CASES = [
    ("select * from Orders o join \"Sales\".\"Lines\" l on o.id = l.id", "read", ["lines", "orders"], False, False),
    ("-- from nowhere\nSELECT 'from x' /* join y */ FROM a.b.c_1 WHERE id IN (1, 2)", "read", ["c_1"], True, False),
    ("with recursive r (a, b) as (select 1 from base), x as not materialized (select * from r) insert into out select * from x join r on true", "write", ["base", "out"], False, False),
    ("with gone as (delete from t returning id) select * from gone", "read", ["t"], False, False),
    ("update s.loans set state = 1 where id = 4 and loans.state = 0", "write", ["loans"], False, True),
    ("update loans set a = 1, b = 2 where id = 4", "write", ["loans"], False, False),
    ("update loans set a = 1 returning *", "write", ["loans"], False, True),
    ("insert into log values (1, 2), (3, 4) on conflict do update set a = 1", "write", ["log"], True, False),
    ("insert into log values (1, 2)", "write", ["log"], False, False),
    ("select * from t where id = any($1) for update of t", "read", ["t"], True, False),
    ("truncate table [Old Rows]", "delete", ["old rows"], False, False),
    ("truncate x", "delete", ["x"], False, False),
    ("delete from `carts`", "delete", ["carts"], False, False),
    ("call something(1)", None, [], False, False),
    ("", None, [], False, False),
    ("select 1 from (select 2) q", "read", [], False, False),
]


def test_statements(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "i int, t string")
    t = F.col("t")
    got = df.select("i", S.sql_operation(t), S.sql_tables(t), S.sql_is_batch(t), S.sql_is_conditional(t)).orderBy("i").collect()
    for r, c in zip(got, CASES, strict=False):
        assert (r[1], r[2], bool(r[3]), bool(r[4])) == c[1:], c[0]
    assert got[-1][1] is None


@pytest.mark.parametrize(("name", "role", "checks"), [
    ("stripeWebhook", "webhook", False), ("webhooks", "webhook", False), ("fetchWebhookSettings", None, False), ("handleWebhook", "webhook", False), ("handleWebhookEvent", "webhook", False), ("mywebhook", None, False),
    ("onCallbackDone", "callback", False), ("PaymentsCallback", "callback", False), ("onCallbacksDone", None, False), ("healthProbe", "probe", False), ("HealthController", "probe", False), ("probe", "probe", False), ("list", None, False),
    ("verifyToken", None, True), ("JWTTokenReader", None, True), ("LibrarianAuth", None, True), ("remember", None, False), ("members_only", None, True), ("disallowed", None, False), ("isAllowed2", None, True), ("author", None, True), ("", None, False),
])
def test_names(spark, name, role, checks):
    r = spark.createDataFrame([(name,)], "n string").select(T.name_role(F.col("n")).alias("r"), S.sounds_like_auth_check(F.col("n")).alias("c")).first()
    assert (r.r, r.c) == (role, checks)
