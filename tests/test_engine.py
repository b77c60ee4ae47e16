"""The query language over a small project tracker, with nulls, ties, self-relations and a bridge table."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lattiq import Catalog, Engine, Field, FrameTables, LimitExceeded, Options, QueryError, Relation, UnsupportedQuery, config
from lattiq.operators.aggregates import flat
from lattiq.plans import batch, prepared, stats
from lattiq.streaming import rows

T0 = dt.datetime(2024, 1, 1, 12, 0, 0, 1)
T1 = dt.datetime(2024, 1, 1, 12, 0, 0, 2)


def one(name, model, parent, child="id"):
    return Relation(name, model, (parent,), (child,), many=False, local=True)


def many(name, model, child, parent="id"):
    return Relation(name, model, (parent,), (child,), many=True)


def catalog():
    c = Catalog(enums={"Priority": ["LOW", "MEDIUM", "HIGH"], "Status": [("OPEN", "open"), ("DONE", "done")]})
    c.add("user", [Field("id", "Int", is_id=True), Field("name", required=False), Field("createdAt", "DateTime", db="created_at")], [many("tasks", "task", "assigneeId"), many("created", "task", "creatorId")], table="users")
    c.add(
        "task",
        [Field("id", "Int", is_id=True), Field("title"), Field("status", "Status"), Field("priority", "Priority", required=False), Field("hours", "Decimal", required=False), Field("meta", "Json", required=False), Field("tags", "String[]", required=False), Field("assigneeId", "Int", db="assignee_id", required=False), Field("creatorId", "Int", db="creator_id"), Field("parentId", "Int", db="parent_id", required=False)],
        [one("assignee", "user", "assigneeId"), one("creator", "user", "creatorId"), one("parent", "task", "parentId"), many("subtasks", "task", "parentId"), many("labels", "taskLabel", "taskId")],
        table="tasks",
    )
    c.add("taskLabel", [Field("taskId", "Int"), Field("labelId", "Int")], [one("task", "task", "taskId"), one("label", "label", "labelId")], key=("taskId", "labelId"))
    c.add("label", [Field("id", "Int", is_id=True), Field("name")], [many("tasks", "taskLabel", "labelId")])
    return c.check()


USERS = [(1, "Ann", T0), (2, None, T1), (3, "Bob%", T0), (4, "b_b\\", T1)]
TASKS = [
    (1, "root", "open", "HIGH", Decimal("1.25"), '{"a":{"b":1}}', ["x", None], 1, 1, None),
    (2, "child", "done", "LOW", Decimal("2.50"), '{"a":{"b":"x"}}', [], 1, 2, 1),
    (3, "leaf", "open", None, None, None, None, None, 2, 2),
    (4, "other", "done", "MEDIUM", Decimal("4.00"), '{"a":{"b":7}}', ["x", "y"], 3, 3, 1),
    (5, "O'ther é", "open", None, Decimal("0.10"), '{"c":true}', ["y"], 3, 1, None),
]
LINKS = [(1, 1), (1, 2), (2, 1), (4, 2)]
LABELS = [(1, "bug"), (2, "feature"), (3, "unused")]


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return FrameTables(
        spark,
        {
            "users": make(USERS, "id int, name string, created_at timestamp"),
            "tasks": make(TASKS, "id int, title string, status string, priority string, hours decimal(10,2), meta string, tags array<string>, assignee_id int, creator_id int, parent_id int"),
            "taskLabel": make(LINKS, "taskId int, labelId int"),
            "label": make(LABELS, "id int, name string"),
        },
    )


@pytest.fixture(scope="module")
def db(spark, tables):
    return Engine(spark, tables, catalog())


def ids(df):
    return [r.id for r in df.collect()]


def found(db, where, model="task"):
    return sorted(ids(db.query(model, "findMany", {"where": where})))


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({}, [1, 2, 3, 4, 5]),
        ({"status": "OPEN"}, [1, 3, 5]),
        ({"priority": None}, [3, 5]),
        ({"priority": {"not": "LOW"}}, [1, 4]),
        ({"NOT": {"priority": "LOW"}}, [1, 4]),
        ({"priority": {"notIn": ["LOW"]}}, [1, 4]),
        ({"priority": {"notIn": ["LOW", None]}}, []),
        ({"priority": {"notIn": []}}, [1, 2, 3, 4, 5]),
        ({"hours": {"not": {"gt": 2, "lt": 3}}}, [1, 4, 5]),
        ({"hours": {"in": [Decimal("2.50"), "0.1"]}}, [2, 5]),
        ({"title": {"contains": "THER", "mode": "insensitive"}}, [4, 5]),
        ({"title": {"startsWith": "O'"}}, [5]),
        ({"title": {"endsWith": "é"}}, [5]),
        ({"OR": []}, []),
        ({"AND": []}, [1, 2, 3, 4, 5]),
        ({"OR": [{}, {"id": 1}]}, [1, 2, 3, 4, 5]),
        ({"tags": {"has": "x"}}, [1, 4]),
        ({"NOT": {"tags": {"has": "x"}}}, [2, 5]),
        ({"tags": {"hasSome": ["y", "z"]}}, [4, 5]),
        ({"NOT": {"tags": {"hasSome": ["y"]}}}, [1, 2]),
        ({"tags": {"hasEvery": ["x", "y"]}}, [4]),
        ({"tags": {"hasEvery": []}}, [1, 2, 4, 5]),
        ({"tags": {"isEmpty": True}}, [2, 3]),
        ({"tags": {"isEmpty": False}}, [1, 4, 5]),
        ({"tags": ["y"]}, [5]),
        ({"tags": {"equals": []}}, [2, 3]),
        ({"tags": {"not": ["y"]}}, [1, 2, 4]),
        ({"meta": {"path": {"path": ["a", "b"], "gt": 0}}}, [1, 4]),
        ({"meta": {"path": ["a", "b"], "equals": "x"}}, [2]),
        ({"meta": {"path": ["c"], "equals": True}}, [5]),
        ({"meta": {"path": None}}, [3]),
        ({"meta": {"string_contains": '"B":1'}}, [1]),
        ({"assignee": {"is": None}}, [3]),
        ({"assignee": None}, [3]),
        ({"assignee": {"isNot": None}}, [1, 2, 4, 5]),
        ({"assignee": {"isNot": {"name": "Ann"}}}, [3, 4, 5]),
        ({"assignee": {"name": "Ann"}}, [1, 2]),
        ({"subtasks": {"some": {"status": "DONE"}}}, [1]),
        ({"subtasks": {"none": {}}}, [3, 4, 5]),
        ({"subtasks": {"every": {"priority": {"not": "LOW"}}}}, [2, 3, 4, 5]),
        ({"subtasks": {"some": {"subtasks": {"some": {}}}}}, [1]),
        ({"parent": {"parent": {"title": "root"}}}, [3]),
        ({"OR": [{"subtasks": {"some": {}}}, {"NOT": {"assignee": {"is": {"name": "Ann"}}}}]}, [1, 2, 3, 4, 5]),
        ({"NOT": {"subtasks": {"some": {"status": "DONE"}}}}, [2, 3, 4, 5]),
        ({"labels": {"some": {"label": {"name": "bug"}}, "every": {"label": {"name": {"not": "feature"}}}}}, [2]),
    ],
)
def test_filters(db, where, want):
    assert found(db, where) == want


def test_like_wildcards_and_backslashes(spark, tables, db):
    assert found(db, {"name": {"contains": "B_b"}}, "user") == [3] and found(db, {"name": {"endsWith": "\\"}}, "user") == [4]
    plain = Engine(spark, tables, catalog(), Options(escape_like=True))
    assert found(plain, {"name": {"contains": "%"}}, "user") == [3] and found(plain, {"name": {"contains": "_"}}, "user") == [4]


def test_dates_keep_microseconds(db):
    assert found(db, {"createdAt": T0}, "user") == [1, 3] and found(db, {"createdAt": {"gt": T0.isoformat()}}, "user") == [2, 4]


def test_order_of_nulls_and_enums(db):
    order = lambda o, **more: ids(db.task.find_many({"orderBy": o, **more}))
    assert order([{"priority": "asc"}, {"id": "asc"}]) == [2, 4, 1, 3, 5]
    assert order([{"priority": "desc"}, {"id": "asc"}]) == [3, 5, 1, 4, 2]
    assert order([{"priority": {"sort": "asc", "nulls": "first"}}, {"id": "desc"}]) == [5, 3, 2, 4, 1]
    assert order([{"assignee": {"name": "desc"}}, {"id": "asc"}], take=3) == [3, 4, 5]
    assert order([{"priority": "asc"}, {"id": "asc"}], take=-2) == [3, 5]
    assert order([{"priority": "asc"}, {"id": "asc"}], take=-2, skip=1) == [1, 3]
    assert order({"id": "asc"}, take=0) == [] and order({"id": "asc"}, skip=3) == [4, 5]


def test_cursors(db):
    page = lambda **a: ids(db.task.find_many(a))
    by = [{"priority": "asc"}, {"id": "asc"}]  # 2 4 1 3 5
    assert page(cursor={"id": 3}) == [3, 4, 5] and page(cursor={"id": 3}, skip=2) == [5]
    assert page(cursor={"id": 3}, orderBy={"id": "desc"}, take=2) == [3, 2]
    assert page(cursor={"id": 4}, orderBy=by, take=3) == [4, 1, 3]
    assert page(cursor={"id": 3}, orderBy=by) == [3, 5]  # a null sort key, tied
    assert page(cursor={"id": 1}, orderBy=by, take=-2) == [4, 1]
    assert page(cursor={"id": 99}, orderBy=by) == [] and page(cursor={"id": 0}) == [1, 2, 3, 4, 5]
    links = db.taskLabel.find_many({"cursor": {"taskId_labelId": {"taskId": 1, "labelId": 2}}, "orderBy": [{"taskId": "asc"}, {"labelId": "asc"}]}).collect()
    assert [tuple(r) for r in links] == [(1, 2), (2, 1), (4, 2)]


def test_distinct(spark, tables, db):
    assert ids(db.task.find_many({"distinct": ["status"], "orderBy": {"id": "desc"}})) == [4, 5]
    own = Engine(spark, tables, catalog(), Options(dialect="sqlite"))
    assert ids(own.task.find_many({"distinct": ["status"], "orderBy": {"id": "desc"}})) == [5, 4]
    assert db.task.count({"distinct": ["priority"]}).first()._count._all == 4


def test_nested_rows(db):
    got = db.user.find_many({"orderBy": {"id": "asc"}, "include": {"tasks": {"orderBy": {"id": "desc"}, "select": {"id": True, "parent": {"select": {"title": True}}, "_count": {"select": {"labels": True}}}}, "_count": True}}).collect()
    assert [[t.id for t in r.tasks] for r in got] == [[2, 1], [], [5, 4], []]
    assert [[t.parent and t.parent.title for t in r.tasks] for r in got] == [["root", None], [], [None, "root"], []]
    assert [[t._count.labels for t in r.tasks] for r in got] == [[1, 2], [], [0, 1], []]
    assert [r._count.asDict() for r in got][:2] == [{"tasks": 2, "created": 2}, {"tasks": 0, "created": 2}]


def test_child_pages(db):
    tasks = lambda **a: [[t.id for t in r.tasks] for r in db.user.find_many({"orderBy": {"id": "asc"}, "select": {"id": True, "tasks": {"orderBy": {"id": "asc"}, **a}}}).collect()]
    assert tasks(take=1) == [[1], [], [4], []] and tasks(skip=1) == [[2], [], [5], []] and tasks(take=-1) == [[2], [], [5], []]
    assert tasks(where={"status": "DONE"}) == [[2], [], [4], []] and tasks(distinct=["status"]) == [[1, 2], [], [4, 5], []]


def test_a_limited_page_has_its_children(db):
    got = db.task.find_many({"orderBy": {"id": "asc"}, "skip": 1, "take": 2, "include": {"subtasks": {"include": {"creator": True}}, "parent": True}}).collect()
    assert [(r.id, [s.id for s in r.subtasks], r.parent.id) for r in got] == [(2, [3], 1), (3, [], 2)] and got[0].subtasks[0].creator.id == 2


def test_first_unique_and_attached(db):
    assert ids(db.task.find_first({"orderBy": {"id": "asc"}, "skip": 1})) == [2] and ids(db.task.find_unique({"where": {"id": 4}})) == [4]
    assert db.task.find_unique({"where": {"id": 40}}).count() == 0
    out = db.attach_includes(db.user.find_many({"where": {"id": {"lte": 2}}, "select": {"id": True, "name": True}}), "user", {"tasks": True}).orderBy("id").collect()
    assert [len(r.tasks) for r in out] == [2, 0]


def test_aggregates(db):
    row = flat(db.task.aggregate({"_count": {"_all": True, "priority": True}, "_sum": {"hours": True}, "_avg": {"hours": True}, "_min": {"title": True}, "_max": {"id": True}})).first()
    assert tuple(row) == (5, 3, Decimal("7.85"), Decimal("1.962500"), "O'ther é", 5)
    empty = flat(db.task.aggregate({"where": {"id": 0}, "_count": True, "_sum": {"hours": True}})).first()
    assert tuple(empty) == (0, None)
    got = flat(db.task.group_by({"by": ["assigneeId"], "_count": True, "orderBy": {"_count": {"_all": "desc"}}, "having": {"OR": [{"hours": {"_sum": {"gt": 4}}}, {"_count": {"_all": {"equals": 1}}}]}})).collect()
    assert sorted(map(tuple, got), key=str) == [(3, 2), (None, 1)]
    # OR stands beside its siblings as one condition
    assert db.task.group_by({"by": ["status"], "having": {"_count": {"_all": 99}, "OR": [{"_count": {"_all": 2}}, {"_count": {"_all": 3}}]}}).count() == 0


def test_batches(db):
    got = batch.batch(db, {"a": ("user", "count", {}), "b": ("task", "findMany", {"where": {"id": 1}})})
    assert got["a"].first()._count._all == 4 and ids(got["b"]) == [1]
    counts = [{"model": "task", "args": {"where": {"status": "OPEN"}}}, {"model": "user"}, {"model": "task", "args": {"where": {"OR": [{"subtasks": {"some": {}}}, {"id": 5}]}}}, {"model": "task", "args": {"take": 2}}]
    assert batch.batch_count(db, counts) == [3, 4, 3, 2] and batch.batch_count(db, []) == []
    plan = batch.fused_counts(db, [("task", {"where": {"id": 1}}), ("task", {"where": {"id": 2}})])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # one scan
    assert [r[0][0] for r in batch.transaction(db, [{"model": "user", "method": "count"}, {"model": "label", "method": "count"}], "Serializable", 60)] == [(4,), (3,)]
    with pytest.raises(UnsupportedQuery):
        batch.transaction(db, [{"model": "user", "method": "create"}])
    with pytest.raises(QueryError):
        batch.transaction(db, [], "Snapshot")


def test_prepared_streams_and_statistics(db, tmp_path):
    registry = prepared.Registry(db)
    query = registry.prepare("page", "task", "findMany", {"where": {"status": prepared.Param("s")}, "orderBy": {"id": "asc"}, "take": prepared.Param("n")})
    assert ids(query(s="OPEN", n=2)) == [1, 3] and registry.find("task", "findMany", {"take": prepared.Param("x"), "orderBy": {"id": "asc"}, "where": {"status": prepared.Param("y")}}) is query
    with pytest.raises(QueryError):
        query(s="OPEN")
    assert [r.id for r in rows.iterate(db, "task", {"orderBy": {"id": "desc"}})] == [5, 4, 3, 2, 1]
    assert rows.fold(db, "task", {}, list, lambda s, r: [*s, r.id], sorted) == [1, 2, 3, 4, 5]
    assert rows.tree_fold(db.task.find_many(), 0, lambda s, r: s + r.id, lambda a, b: a + b) == 15
    fan = stats.fan_out(db, "user", "tasks").first()
    assert (fan.parents, fan.average, fan.maximum, fan.coverage) == (2, 2.0, 2, 0.5)
    made = stats.collect(db, str(tmp_path / "s.json"))
    assert made["user"]["tasks"]["maximum"] == 2 and stats.load(str(tmp_path / "s.json")) == made


def test_unique_keys(db):
    assert ids(db.task.find_unique({"where": {"id": {"equals": 4}}})) == [4]
    assert db.taskLabel.find_unique({"where": {"taskId_labelId": {"taskId": 1, "labelId": 2}}}).count() == 1
    for model, where in (("task", {"status": "OPEN"}), ("task", {"id": {"gt": 1}}), ("task", {"id": {"in": [1, 2]}}), ("task", {"OR": [{"id": 1}]}), ("taskLabel", {"taskId": 1})):
        with pytest.raises(QueryError):
            db.query(model, "findUnique", {"where": where})


def test_cursor_rules(spark, tables, db):
    from lattiq import Options

    with pytest.raises(QueryError):
        db.taskLabel.find_many({"cursor": {"taskId_labelId": {"taskId": 1, "labelId": 2}}, "orderBy": [{"labelId": "asc"}, {"taskId": "asc"}]})
    with pytest.raises(UnsupportedQuery):
        Engine(spark, tables, db.catalog, Options(dialect="sqlite")).task.find_many({"cursor": {"status": "OPEN"}, "distinct": ["status"], "orderBy": {"status": "asc"}})


def test_batches_keep_order_and_counts_select(db):
    row = batch.batch_row(db, {"down": ("task", "findMany", {"orderBy": {"id": "desc"}}), "one": ("task", "findFirst", {"orderBy": {"id": "asc"}}), "none": ("task", "findFirst", {"where": {"id": 99}})}).first()
    assert [r.id for r in row.down] == [5, 4, 3, 2, 1] and row.one.id == 1 and row.none is None
    every = db.task.find_many().collect()
    got = db.task.count({"select": {"_all": True, "assigneeId": True}}).first()._count
    assert (got._all, got.assigneeId) == (len(every), sum(r.assigneeId is not None for r in every))
    with pytest.raises(QueryError):
        db.task.count({"select": {"nothing": True}})


def test_compiled_queries(spark, tables, db):
    from lattiq import compiler

    made = compiler(spark, tables, db.catalog)("task", "findMany", {"where": {"id": 4}})
    assert "Filter" in made.plan and ids(made.frame) == [4]


def test_hook_and_sql(spark, tables):
    seen = []
    e = Engine(spark, tables, catalog(), on_query=seen.append)
    e.task.count({"where": {"id": 1}})
    assert seen[0]["model"] == "task" and seen[0]["method"] == "count"
    assert e.sql("SELECT :x + 1 AS y", x=4).first().y == 5


@pytest.mark.parametrize(
    ("model", "method", "args"),
    [
        ("task", "findMany", {"where": {"nothing": 1}}),
        ("task", "findMany", {"where": []}),
        ("task", "findMany", {"where": {"id": {"gt": None}}}),
        ("task", "findMany", {"where": {"id": {"near": 3}}}),
        ("task", "findMany", {"where": {"status": "open"}}),
        ("task", "findMany", {"where": {"id": "x"}}),
        ("task", "findMany", {"where": {"subtasks": {"is": {}}}}),
        ("task", "findMany", {"where": {"subtasks": {}}}),
        ("task", "findMany", {"where": {"assignee": {"some": {}}}}),
        ("task", "findMany", {"where": {"tags": {"has": None}}}),
        ("task", "findMany", {"where": {"meta": {"path": ["a b"], "equals": 1}}}),
        ("task", "findMany", {"where": {"meta": {"path": {"path": ["a"]}}}}),
        ("task", "findMany", {"where": {"hours": float("nan")}}),
        ("task", "findMany", {"select": {"id": True}, "include": {"labels": True}}),
        ("task", "findMany", {"select": {"id": False}}),
        ("task", "findMany", {"include": {"title": True}}),
        ("task", "findMany", {"orderBy": {"subtasks": {"id": "asc"}}}),
        ("task", "findMany", {"orderBy": {"assignee": {"_count": "asc"}}}),
        ("task", "findMany", {"orderBy": {"id": "up"}}),
        ("task", "findMany", {"take": -1}),
        ("task", "findMany", {"take": 1.5}),
        ("task", "findMany", {"skip": -1}),
        ("task", "findMany", {"cursor": {"id": None}}),
        ("task", "findMany", {"distinct": []}),
        ("task", "findMany", {"distinct": ["id", "id"]}),
        ("task", "findMany", {"cursor": {"id": 1}, "distinct": ["status"]}),
        ("task", "findMany", {"include": {"subtasks": {"cursor": {"id": 1}}}}),
        ("task", "findMany", {"unknown": 1}),
        ("task", "count", {"take": -1}),
        ("task", "aggregate", {}),
        ("task", "aggregate", {"_sum": {"title": True}}),
        ("task", "aggregate", {"_max": {"_all": True}}),
        ("task", "groupBy", {"by": []}),
        ("task", "groupBy", {"by": ["id", "id"]}),
        ("task", "groupBy", {"by": ["status"], "having": {"status": "OPEN"}}),
        ("task", "groupBy", {"by": ["status"], "orderBy": {"id": "asc"}}),
        ("task", "create", {}),
        ("nobody", "findMany", {}),
    ],
)
def test_wrong_arguments_raise(db, model, method, args):
    with pytest.raises(QueryError):
        db.query(model, method, args)


def test_limits(db):
    config.set_limits(query_depth=2, array_size=2, include_depth=1)
    try:
        with pytest.raises(LimitExceeded):
            db.task.find_many({"where": {"NOT": {"NOT": {"NOT": {"id": 1}}}}})
        with pytest.raises(LimitExceeded):
            db.task.find_many({"where": {"tags": {"hasSome": ["a", "b", "c"]}}})
        with pytest.raises(LimitExceeded):
            db.task.find_many({"include": {"creator": {"include": {"tasks": True}}}})
    finally:
        config.reset_limits()
    with pytest.raises(QueryError):
        db.task.find_many({"include": {"subtasks": {"include": {"subtasks": True}}}})
    with pytest.raises(KeyError):
        config.set_limits(nothing=1)


def test_plans(db):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan(db.task.find_many({"where": {"subtasks": {"some": {}}}}))
    assert "LeftAnti" in plan(db.task.find_many({"where": {"subtasks": {"every": {"id": 1}}}}))
    top = db.task.find_many({"orderBy": {"id": "asc"}, "take": 2})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_catalogs_are_checked():
    c = Catalog()
    c.add("a", [Field("id", "Int")], [Relation("b", "b", ("id",), ("id", "x"), many=True)])
    c.add("b", [Field("id", "Int"), Field("x")])
    with pytest.raises(QueryError):
        c.check()
    assert F is not None
