"""Values, errors and session rules of the dialect."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest

from tsqlspark import TsqlError, TsqlSession


@pytest.fixture(scope="module")
def tsql(spark):
    return TsqlSession(spark)


def rows(tsql, text):
    return [tuple(r) for r in tsql.sql(text).collect()]


#: One batch each, so that a whole group costs one Spark job: (expression, value).
VALUES = [
    ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 2", -1), ("2.0 / 3.0", D("0.666666")), ("1 | 2 + 3", 6), ("-1 & 2", 2), ("~5", -6), ("5 ^ 1", 4), ("$1.5 * 2", D("3.0000")),
    ("ROUND(123.4545, 2)", D("123.4500")), ("ROUND(-2.5, 0)", D("-3.0")), ("ROUND(150.75, 0, 1)", D("150.00")), ("ROUND(1250, -2)", 1300), ("POWER(2, -1)", 0), ("POWER(2, 10)", 1024), ("SIGN(-5.5)", D("-1.0")), ("CEILING(1.2)", D("2")), ("FLOOR(-1.2)", D("-2")), ("ABS(-3)", 3),
    ("SUBSTRING('abcdef', 0, 3)", "ab"), ("SUBSTRING('abcdef', -5, 3)", ""), ("STUFF('abcdef', 2, 99, 'X')", "aX"), ("STUFF('abc', 9, 1, 'x')", None), ("CHARINDEX('', 'abc')", 0), ("CHARINDEX('B', 'abc')", 2), ("PATINDEX('%[0-9]%', 'ab12')", 3), ("REPLACE('ABCabc', 'b', 'X')", "AXCaXc"),
    ("LEN('ab  ')", 2), ("DATALENGTH(N'ab')", 4), ("DATALENGTH('ab ')", 3), ("REPLICATE('ab', -1)", None), ("REVERSE('abc')", "cba"), ("CONCAT('a', NULL, 1)", "a1"), ("'a' + NULL", None), ("QUOTENAME('a]b')", "[a]]b]"), ("ASCII('€')", 128), ("CHAR(128)", "€"), ("UNICODE(N'')", None), ("NCHAR(945)", "α"), ("LEFT('abc', 2)", "ab"), ("RIGHT('abc', 2)", "bc"),
    ("ISNULL(CAST(NULL AS varchar(3)), 'abcdef')", "abc"), ("COALESCE(NULL, 2, 3.5)", D("2.0")), ("NULLIF(1, 1)", None), ("IIF(1 = 2, 'x', 'yy')", "yy"),
    ("CASE WHEN 'abc ' LIKE 'abc' THEN 1 ELSE 0 END", 1), ("CASE WHEN 'abc' LIKE 'abc ' THEN 1 ELSE 0 END", 0), ("CASE WHEN 'a' = 'A  ' THEN 1 ELSE 0 END", 1), ("CASE WHEN '5%' LIKE '5!%' ESCAPE '!' THEN 1 ELSE 0 END", 1), ("CASE WHEN 'b' LIKE '[^a-c]' THEN 1 ELSE 0 END", 0), ("CASE WHEN 0x01 = 0x0100 THEN 1 ELSE 0 END", 1),
    ("DATEDIFF(year, '2019-12-31', '2020-01-01')", 1), ("DATEDIFF(week, '2020-02-29', '2020-03-01')", 1), ("DATEDIFF(hour, '2020-01-01 00:59:00', '2020-01-01 01:01:00')", 1), ("DATEADD(month, 1, CAST('2020-01-31' AS date))", date(2020, 2, 29)), ("EOMONTH('2020-02-05', NULL)", date(2020, 2, 29)), ("DATEFROMPARTS(2020, 2, 29)", date(2020, 2, 29)), ("DATEPART(weekday, '2020-03-01')", 1), ("DATEPART(week, '2020-03-01')", 10), ("DATENAME(month, '2020-03-01')", "March"),
    ("CAST(2.5 AS int)", 2), ("CAST(-2.5 AS int)", -2), ("CAST($2.5 AS int)", 3), ("CAST(1.005 AS decimal(5,2))", D("1.01")), ("TRY_CAST('x' AS int)", None), ("CAST('' AS int)", 0), ("CAST(12345 AS varchar(3))", "*"), ("CAST('abcdef' AS varchar(3))", "abc"), ("CONVERT(varchar(10), CAST('2020-03-01' AS date), 101)", "03/01/2020"), ("CONVERT(varchar(30), CAST('2020-03-01 13:05:06' AS datetime), 0)", "Mar  1 2020  1:05PM"), ("CONVERT(varchar(23), CAST('2020-03-01 13:05:06.123' AS datetime), 121)", "2020-03-01 13:05:06.123"), ("CONVERT(varchar(8), CAST('2020-03-01' AS datetime), 112)", "20200301"),
    ("CAST('2020-01-01 00:00:00.005' AS datetime)", datetime(2020, 1, 1, 0, 0, 0, 7000)), ("CAST('12:34:56' AS time(0))", "12:34:56"), ("ISNUMERIC('1e5')", 1), ("ISNUMERIC('abc')", 0), ("ISDATE('20200230')", 0), ("SQL_VARIANT_PROPERTY(CAST(1 AS decimal(5,2)), 'Scale')", 2), ("DB_NAME()", "master"), ("SCHEMA_NAME()", "dbo"), ("@@TRANCOUNT", 0),
]


def test_values(tsql):
    select = ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(VALUES))
    got = rows(tsql, f"SELECT {select}")[0]
    wrong = [(e, want, have) for (e, want), have in zip(VALUES, got, strict=True) if want != have]
    assert not wrong


TYPES = [
    ("2.0 / 3.0", "decimal(8,6)"), ("1.5 * 2.25", "decimal(6,3)"), ("CAST(1 AS bigint) + 1", "bigint"), ("3000000000", "decimal(10,0)"), ("1 + 2.5", "decimal(3,1)"), ("COUNT(*)", "int"), ("SUM(k)", "int"), ("AVG(k)", "int"), ("SUM(CAST(k AS decimal(5,2)))", "decimal(38,2)"), ("AVG(CAST(k AS decimal(5,2)))", "decimal(38,6)"), ("COUNT_BIG(*)", "bigint"),
]


def test_types(tsql):
    df = tsql.sql("SELECT " + ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(TYPES)) + " FROM (VALUES (1), (2), (2)) t(k)")
    assert [t for _, t in df.dtypes] == [t for _, t in TYPES]


ERRORS = [
    ("SELECT a FROM missing", 208), ("SELECT x FROM (VALUES (1)) t(a)", 207), ("SELECT t.x FROM (VALUES (1)) s(a)", 4104), ("SELECT a FROM (VALUES (1)) s(a), (VALUES (2)) t(a)", 209), ("SELECT FOO(1)", 195), ("SELECT b, COUNT(*) AS n FROM (VALUES (1, 2)) t(a, b) GROUP BY a", 8120),
    ("SELECT 1 FROM (VALUES (1)) t(a) WHERE COUNT(*) > 1", 147), ("SELECT SUM(SUM(a)) FROM (VALUES (1)) t(a)", 130), ("SELECT (1 = 1)", 102), ("SELECT 1 AS a UNION SELECT 1, 2", 205), ("SELECT a FROM (VALUES (1)) t(a) ORDER BY 3", 108), ("SELECT DISTINCT a FROM (VALUES (1, 2)) t(a, b) ORDER BY b", 145), ("SELECT TOP 1 WITH TIES a FROM (VALUES (1)) t(a)", 1062), ("SELECT TOP (-1) a FROM (VALUES (1)) t(a)", 127),
    ("SELECT SUM('a') AS s", 8117), ("SELECT @nope", 137), ("DECLARE @a int, @a int", 134), ("SELECT (SELECT 1, 2)", 116), ("SELECT 1 FROM (VALUES (1)) t(a), (VALUES (1)) t(b)", 1013), ("SELECT NULLIF(NULL, 1)", 4151), ("SELECT 'a' * 'b'", 8117), ("SELECT CAST(1 AS xml)", 2715), ("SELECT CAST(1 AS date)", 529), ("ROLLBACK", 3903), ("BREAK", 135), ("GOTO nowhere", 133), ("SELECT CONVERT(varchar(10), GETDATE(), 99)", 281), ("SELECT DATEPART(foo, GETDATE())", 155), ("EXEC nothing", 2812), ("WITH c AS (SELECT 1) SELECT * FROM c", 8155), ("SELECT a FROM sys.tables WITH (NOLOCK, HOLDLOCK)", 1047),
]


@pytest.mark.parametrize("text,number", ERRORS)
def test_errors(tsql, text, number):
    with pytest.raises(TsqlError) as e:
        tsql.sql(text)
    assert e.value.number == number


def test_syntax_error_voids_the_batch(tsql):
    sent = tsql.execute("PRINT 'a'\nSELECT FROM x")
    assert [r.kind for r in sent] == ["error"]


def test_queries(tsql):
    assert rows(tsql, "SELECT v FROM (VALUES (1), (NULL)) t(v) WHERE v NOT IN (2, NULL)") == []
    assert rows(tsql, "SELECT TOP 2 WITH TIES v FROM (VALUES (1), (2), (2), (3)) t(v) ORDER BY v") == [(1,), (2,), (2,)]
    assert rows(tsql, "SELECT TOP 50 PERCENT v FROM (VALUES (1), (2), (3)) t(v) ORDER BY v DESC") == [(3,), (2,)]
    assert rows(tsql, "SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 2.5") == [(D("1.0"),), (D("2.0"),), (D("2.5"),)]
    assert rows(tsql, "SELECT 1 AS a WHERE 3 > ALL (SELECT v FROM (VALUES (1), (2)) t(v)) AND 1 = ANY (SELECT 1 AS x)") == [(1,)]
    assert rows(tsql, "SELECT 1 AS a WHERE 1 > ALL (SELECT v FROM (VALUES (0), (NULL)) t(v))") == []
    assert sorted(rows(tsql, "SELECT s, COUNT(*) AS n FROM (VALUES ('a'), ('A '), ('b')) t(s) GROUP BY s"))[0][1] == 2
    assert len(rows(tsql, "SELECT DISTINCT s FROM (VALUES ('a'), ('A'), ('b')) t(s)")) == 2
    assert rows(tsql, "SELECT 'A' AS s INTERSECT SELECT 'a'") == [("A",)]


def test_control_flow(tsql):
    assert rows(tsql, "DECLARE @i int = 0, @s varchar(20) = ''; WHILE @i < 5 BEGIN SET @i += 1; IF @i = 2 CONTINUE; IF @i = 4 BREAK; SET @s = @s + CAST(@i AS varchar(5)); END; SELECT @i AS i, @s AS s") == [(4, "13")]
    assert rows(tsql, "DECLARE @x int = 1; GOTO done; SET @x = 2; done: SELECT @x AS x") == [(1,)]
    assert rows(tsql, "DECLARE @s varchar(20) = ''; SELECT @s = @s + v FROM (VALUES ('b', 2), ('a', 1)) t(v, k) ORDER BY k; SELECT @s AS s") == [("ab",)]
    assert rows(tsql, "DECLARE @r int; EXEC sp_executesql N'SET @o = @i * 2', N'@i int, @o int OUTPUT', @i = 4, @o = @r OUTPUT; SELECT @r AS r") == [(8,)]
    assert rows(tsql, "DECLARE @h int; EXEC sp_prepare @h OUTPUT, N'@a int', N'SELECT @a + 1 AS v'; EXEC sp_execute @h, 41") == [(42,)]
    assert [r.text for r in tsql.execute("IF 1 = 2 PRINT 'no' ELSE PRINT 'yes'")] == ["yes"]


def test_writes_and_constraints(tsql):
    tsql.sql("CREATE TABLE parent (id int PRIMARY KEY); CREATE TABLE child (id int IDENTITY(10, 5) PRIMARY KEY, p int REFERENCES parent (id), n nvarchar(5) NOT NULL DEFAULT 'x', v decimal(6,2) CHECK (v >= 0), w AS v * 2, CONSTRAINT u UNIQUE (n, v))")
    tsql.sql("INSERT INTO parent VALUES (1), (2); INSERT INTO child (p, n, v) VALUES (1, 'a', 1.5), (NULL, DEFAULT, 2)")
    assert rows(tsql, "SELECT id, p, n, v, w FROM child ORDER BY id") == [(10, 1, "a", D("1.50"), D("3.00")), (15, None, "x", D("2.00"), D("4.00"))]
    for text, number in (
        ("INSERT INTO child (p, v) VALUES (9, 1)", 547), ("INSERT INTO child (n, v) VALUES ('b', -1)", 547), ("INSERT INTO child (n) VALUES (NULL)", 515), ("INSERT INTO child (n, v) VALUES ('A', 1.5)", 2627), ("INSERT INTO child (n, v) VALUES ('toolong', 1)", 2628), ("DELETE FROM parent WHERE id = 1", 547),
        ("TRUNCATE TABLE parent", 4712), ("DROP TABLE parent", 3726), ("INSERT INTO child (id, n) VALUES (1, 'q')", 544), ("UPDATE child SET w = 1", 271), ("CREATE TABLE child (a int)", 2714), ("CREATE UNIQUE INDEX i ON child (p, n); INSERT INTO child (p, n, v) VALUES (1, 'a', 7)", 2601),
    ):
        with pytest.raises(TsqlError) as e:
            tsql.sql(text)
        assert e.value.number == number, text
    assert rows(tsql, "UPDATE child SET v = v + 1 WHERE n = 'A'; SELECT v, w, @@ROWCOUNT AS n FROM child WHERE p = 1") == [(D("2.50"), D("5.00"), 1)]
    assert rows(tsql, "UPDATE c SET v = 9 FROM child c JOIN (VALUES (1), (1)) t(k) ON t.k = c.p; SELECT v FROM child WHERE p = 1") == [(D("9.00"),)]
    assert rows(tsql, "BEGIN TRAN; DELETE FROM child; SAVE TRAN s; INSERT INTO child (n) VALUES ('z'); ROLLBACK TRAN s; SELECT COUNT(*) AS n FROM child; ROLLBACK") == [(0,)]
    assert rows(tsql, "SELECT COUNT(*) AS n FROM child") == [(2,)]
    tsql.sql("ALTER TABLE child ADD extra int NOT NULL DEFAULT 3")
    assert rows(tsql, "SELECT extra, COL = n FROM child ORDER BY id")[0] == (3, "a")
    assert rows(tsql, "SELECT CONSTRAINT_TYPE FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS WHERE TABLE_NAME = 'child' ORDER BY CONSTRAINT_TYPE") == [("CHECK",), ("FOREIGN KEY",), ("PRIMARY KEY",), ("UNIQUE",)]
    assert rows(tsql, "SELECT n.name FROM sys.tables n WHERE n.name = 'CHILD'") == [("child",)]


def test_plans_push_down(spark, tmp_path):
    from tsqlspark import BINARY

    spark.range(100).selectExpr("id AS a", "id % 7 AS b", "cast(id AS string) AS c").write.parquet(f"{tmp_path}/t.parquet")
    df = TsqlSession(spark, BINARY).load(str(tmp_path), ["t"]).sql("SELECT a FROM t WHERE b = 3 AND a > 10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,10)" in plan and "EqualTo(b,3)" in plan
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan


def test_stream(spark, tmp_path):
    session = TsqlSession(spark)
    session.register("ticks", spark.readStream.format("rate").load())
    assert session.sql("SELECT value * 2 AS v FROM ticks WHERE value > 3").isStreaming


def test_errors_while_rows_are_read(spark):
    """They have the dialect's numbers, end their statement only, and are seen by @@ERROR."""
    session = TsqlSession(spark)
    df = session.sql("SELECT 1 / (a - 1) AS v FROM (VALUES (1)) t(a)")
    for read in (df.collect, df.toPandas, df.show, lambda: df.head(1)):
        with pytest.raises(TsqlError) as e:
            read()
        assert e.value.number == 8134
    assert session.error == 8134
    sent = session.execute("SELECT a / (a - 1) AS v FROM (VALUES (1)) t(a); IF @@ERROR = 8134 PRINT 'seen'; PRINT 'on'")
    assert [(r.kind, r.number or r.text) for r in sent if r.kind != "rows"] == [("error", 8134), ("message", "seen"), ("message", "on")]
    sent = session.execute("CREATE TABLE e (k int PRIMARY KEY); INSERT INTO e VALUES (1); INSERT INTO e VALUES (1); INSERT INTO e VALUES (2); SELECT COUNT(*) AS n FROM e")
    assert [r.number for r in sent if r.kind == "error"] == [2627] and sent[-1].df.collect()[0][0] == 2
    sent = session.execute("SET XACT_ABORT ON; BEGIN TRAN; DELETE FROM e; SELECT 1 / (k - k) AS v FROM (VALUES (1)) t(k); PRINT 'never'")
    assert sent[-1].number == 8134 and not session.transactions
    assert rows(session, "SELECT COUNT(*) AS n FROM e") == [(2,)]
    for text, number in (("SELECT LEFT('abc', a) AS v FROM (VALUES (-1)) t(a)", 536), ("SELECT SUBSTRING('abc', 1, a) AS v FROM (VALUES (-1)) t(a)", 537), ("SELECT DATEDIFF(second, a, '2020-01-01') AS v FROM (VALUES ('1900-01-01')) t(a)", 535), ("SELECT CAST(a AS int) AS v FROM (VALUES ('x')) t(a)", 245)):
        with pytest.raises(TsqlError) as e:
            rows(session, text)
        assert e.value.number == number, text


def test_row_counts(tsql):
    assert rows(tsql, "SELECT v FROM (VALUES (1), (2), (3)) t(v); SELECT TOP (@@ROWCOUNT) v FROM (VALUES (1), (2), (3), (4)) t(v) ORDER BY v") == [(1,), (2,), (3,)]
    assert rows(tsql, "SELECT v FROM (VALUES (1), (2)) t(v); SELECT @@ROWCOUNT + 1 AS n") == [(3,)]


def test_computed_patterns(tsql):
    """A pattern of a row means the same as the literal."""
    texts = ["abc", "ABC ", "a]c", "a[c", "5%", "5x", "a_b", "xay", "", "a\\b", "^a", "a-c", "(a+b)*"]
    patterns = ["[a-b]%", "_B_", "a[]]c", "a[[]c", "5[%]", "[^x]%", "abc", "a!_b", "%", "", "a\\b", "[^^]a", "%[-]%", "(a+b)*", "[", "a[", "[^]"]
    for t in texts:
        cases = [f"CASE WHEN '{t}' LIKE '{p}' THEN 1 ELSE 0 END" for p in patterns]
        literal = rows(tsql, f"SELECT {', '.join(f'{c} AS c{i}' for i, c in enumerate(cases))}")[0]
        values = ", ".join(f"('{p}', {i})" for i, p in enumerate(patterns))
        computed = rows(tsql, f"SELECT CASE WHEN '{t}' LIKE p THEN 1 ELSE 0 END AS v FROM (VALUES {values}) x(p, k) ORDER BY k")
        assert list(literal) == [v for (v,) in computed], t
    assert rows(tsql, "SELECT x FROM (VALUES ('5%', '5!%'), ('5x', '5!%'), ('a_b', 'a!_b')) t(x, p) WHERE x LIKE p ESCAPE '!'") == [("5%",), ("a_b",)]


def test_ties_and_ordered_folds(tsql):
    assert rows(tsql, "SELECT TOP 2 WITH TIES v, k FROM (VALUES (1, 'a'), (2, 'b'), (2, 'B'), (3, 'c')) t(v, k) ORDER BY k") == [(1, "a"), (2, "b"), (2, "B")]
    assert rows(tsql, "SELECT TOP 2 WITH TIES v FROM (VALUES (1), (NULL), (NULL), (NULL)) t(v) ORDER BY v") == [(None,), (None,)]
    assert rows(tsql, "SELECT TOP 9 WITH TIES v FROM (VALUES (1), (NULL)) t(v) ORDER BY v DESC") == [(1,), (None,)]
    assert rows(tsql, "SELECT TOP 2 WITH TIES a, b FROM (VALUES (1, 5), (1, 4), (1, 4), (2, 1)) t(a, b) ORDER BY a DESC, b") == [(2, 1), (1, 4), (1, 4)]
    assert rows(tsql, "DECLARE @s varchar(20) = ''; SELECT @s = @s + v FROM (VALUES ('b', 2, 1), ('a', 1, 1), ('c', 1, 0)) t(v, k, j) ORDER BY j DESC, k; SELECT @s AS s") == [("abc",)]


def test_writes_to_a_frame_that_is_not_a_file(spark):
    """Rows are found again by stored numbers, whatever order the frame's rows come in; many inserts are put together."""
    session = TsqlSession(spark)
    session.register("t", spark.range(1000).selectExpr("cast(id AS int) AS k", "cast(id % 7 AS int) AS v").repartition(7, "v"))
    assert rows(session, "UPDATE t SET v = k WHERE k % 3 = 0; DELETE FROM t WHERE k % 5 = 0; SELECT COUNT(*) AS n, SUM(CASE WHEN v = CASE WHEN k % 3 = 0 THEN k ELSE k % 7 END THEN 0 ELSE 1 END) AS wrong FROM t") == [(800, 0)]
    session.sql("CREATE TABLE many (k int PRIMARY KEY)")
    for k in range(40):
        session.sql(f"INSERT INTO many VALUES ({k})")
    assert len(session.table(["many"]).pieces) < 34
    assert rows(session, "DELETE FROM many WHERE k % 2 = 1; UPDATE many SET k = k + 1 WHERE k > 30; SELECT COUNT(*) AS n, SUM(k) AS s FROM many") == [(20, sum(range(0, 40, 2)) + 4)]


def test_catalogue_procedures(spark):
    session = TsqlSession(spark)
    session.sql("CREATE TABLE p (k varchar(5) PRIMARY KEY, j int); CREATE TABLE c (k varchar(5) CONSTRAINT f REFERENCES p (k), v int); CREATE INDEX ix ON c (v)")
    assert [r[7] for r in rows(session, "EXEC sp_fkeys @fktable_name = 'C'")] == ["k"] and rows(session, "EXEC sp_special_columns 'p'")[0][1] == "k"
    assert [r[5] for r in rows(session, "EXEC sp_statistics 'c'")] == [None, "ix"] and rows(session, "EXEC sp_stored_procedures") == []
    assert rows(session, "EXEC sp_describe_undeclared_parameters N'SELECT * FROM p WHERE j > @a AND k LIKE @b'") == [(1, "@a", "int"), (2, "@b", "varchar(5)")]
    assert rows(session, "EXEC sp_spaceused 'p'")[0][:2] == ("p", "0") and rows(session, "EXEC sp_datatype_info 4")[0][0] == "int"
    for text, number in (("EXEC sp_fkeys", 15252), ("EXEC sp_spaceused 'nope'", 15009), ("ALTER DATABASE nope SET RECOVERY SIMPLE", 5011), ("CREATE SCHEMA dbo", 2714)):
        with pytest.raises(TsqlError) as e:
            session.sql(text)
        assert e.value.number == number


def test_views_have_all_columns(tsql):
    for view, columns in (
        ("sys.databases", "recovery_model_desc, is_read_committed_snapshot_on, user_access_desc"), ("sys.tables", "temporal_type, is_memory_optimized, lock_escalation_desc"), ("sys.columns", "is_sparse, is_rowguidcol, default_object_id"), ("sys.indexes", "has_filter, filter_definition, is_disabled"),
        ("sys.foreign_keys", "is_disabled, delete_referential_action"), ("sys.check_constraints", "is_not_trusted, definition"), ("sys.default_constraints", "parent_column_id, is_system_named"), ("INFORMATION_SCHEMA.COLUMNS", "DOMAIN_NAME, COLLATION_NAME"), ("INFORMATION_SCHEMA.VIEWS", "VIEW_DEFINITION"),
    ):
        tsql.sql(f"SELECT {columns} FROM {view}").collect()
