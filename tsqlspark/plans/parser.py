"""T-SQL text to syntax trees: recursive descent for statements, precedence climbing for expressions."""

from __future__ import annotations

from ..errors import TsqlError
from .lexer import Token, tokenize


#: The isolation level that a table hint names.
LEVELS = {"NOLOCK": 0, "READUNCOMMITTED": 0, "READCOMMITTED": 1, "READCOMMITTEDLOCK": 1, "REPEATABLEREAD": 2, "HOLDLOCK": 3, "SERIALIZABLE": 3, "SNAPSHOT": 4}


class Node:
    """A syntax node: a kind and named parts.  Equal where kind and parts are."""

    def __init__(self, kind: str, **parts):
        self.kind = kind
        self.__dict__.update(parts)

    def get(self, name: str, default=None):
        return self.__dict__.get(name, default)

    def __eq__(self, other):
        return isinstance(other, Node) and self.__dict__ == other.__dict__

    def __hash__(self):
        return hash(self.kind)

    def __repr__(self):
        return f"Node({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items())})"


#: Words that end an expression or an alias position.
RESERVED = set(
    "ADD ALL ALTER AND ANY AS ASC BEGIN BETWEEN BREAK BY CASE CHECK CLOSE COLLATE COLUMN COMMIT CONSTRAINT CONTINUE CONVERT CREATE CROSS CURRENT_TIMESTAMP CURRENT_USER DECLARE "
    "DEFAULT DELETE DESC DISTINCT DROP ELSE END ESCAPE EXCEPT EXEC EXECUTE EXISTS FETCH FOR FOREIGN FROM FULL FUNCTION GO GOTO GROUP HAVING IDENTITY IF IN INDEX INNER INSERT INTERSECT INTO "
    "IS JOIN KEY LEFT LIKE MERGE NOT NULL NULLIF OF OFF ON OPEN OPTION OR ORDER OUTER OVER PERCENT PIVOT PRIMARY PRINT PROCEDURE RAISERROR REFERENCES RETURN RIGHT ROLLBACK SAVE SELECT "
    "SESSION_USER SET SOME SYSTEM_USER TABLE THEN TOP TRAN TRANSACTION TRUNCATE UNION UNIQUE UNPIVOT UPDATE USE USER VALUES VIEW WAITFOR WHEN WHERE WHILE WITH".split()
)
HINTS = set("NOLOCK READUNCOMMITTED READCOMMITTED REPEATABLEREAD SERIALIZABLE HOLDLOCK READPAST UPDLOCK XLOCK ROWLOCK PAGLOCK TABLOCK TABLOCKX NOWAIT SNAPSHOT READCOMMITTEDLOCK".split())
TYPE_WORDS = {"DOUBLE": "PRECISION", "NATIONAL": None}
PREDICATES = {"compare", "and", "or", "not", "in", "in_query", "like", "between", "is_null", "exists", "quantified"}


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = tokenize(text)
        self.i = 0

    # -- tokens ------------------------------------------------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def fail(self, number: int = 102):
        near = self.now.text or "end of text"
        raise TsqlError(156 if number == 102 and self.now.word in RESERVED else number, f"Incorrect syntax near '{near}'.")

    def next(self) -> Token:
        token = self.now
        self.i += 1
        return token

    def at(self, *words: str) -> bool:
        return all(self.peek(k).word == w for k, w in enumerate(words))

    def accept(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            self.fail()

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail()

    def is_op(self, text: str, k: int = 0) -> bool:
        t = self.peek(k)
        return t.kind == "op" and t.text == text

    def name(self) -> str:
        t = self.now
        if t.kind == "qid" or t.kind == "id" and t.word not in RESERVED:
            self.i += 1
            return t.value
        self.fail()

    def dotted(self) -> list[str]:
        parts = [self.name()]
        while self.is_op("."):
            self.i += 1
            parts.append("" if self.is_op(".") else self.name())
        return parts

    # -- statements --------------------------------------------------------------------------------------------------
    def batch(self) -> list[Node]:
        out = []
        while self.now.kind != "eof":
            if not self.op(";"):
                out.append(self.statement())
        return out

    def statement(self) -> Node:
        t, w = self.now, self.now.word
        if t.kind == "id" and self.is_op(":", 1) and w not in RESERVED:
            self.i += 2
            return Node("label", name=t.value)
        handler = getattr(self, f"_{w.lower()}", None) if w in STATEMENTS else None
        if handler:
            return handler()
        if w == "SELECT" or self.is_op("(") or w == "VALUES":
            return Node("select", query=self.query())
        if t.kind in ("id", "qid"):  # a procedure's name alone, at the start of a batch
            if self.i == 0 or w.startswith("SP_"):
                return self._call()
        self.fail()

    def _with(self) -> Node:
        return Node("select", query=self.query())

    def _block_end(self, *words: str) -> list[Node]:
        out = []
        while not self.at(*words):
            if self.now.kind == "eof":
                self.fail()
            if not self.op(";"):
                out.append(self.statement())
        self.i += len(words)
        return out

    def _begin(self) -> Node:
        self.i += 1
        if self.accept("TRAN") or self.accept("TRANSACTION"):
            name = self.next().value if self.now.kind in ("id", "qid", "var") and self.now.word not in RESERVED and self.now.word not in STATEMENTS else None
            return Node("begin_tran", name=name)
        if self.at("TRY"):
            raise TsqlError(50000, "TRY is not implemented.")
        return Node("block", body=self._block_end("END"))

    def _commit(self) -> Node:
        self.i += 1
        self.accept("TRAN") or self.accept("TRANSACTION") or self.accept("WORK")
        return Node("commit", name=self._tran_name())

    def _tran_name(self):
        return self.next().value if self.now.kind in ("id", "qid", "var") and self.now.word not in RESERVED and self.now.word not in STATEMENTS else None

    def _rollback(self) -> Node:
        self.i += 1
        self.accept("TRAN") or self.accept("TRANSACTION") or self.accept("WORK")
        return Node("rollback", name=self._tran_name())

    def _save(self) -> Node:
        self.i += 1
        self.accept("TRAN") or self.expect("TRANSACTION")
        return Node("save", name=self.next().value)

    def _declare(self) -> Node:
        self.i += 1
        items = []
        while True:
            var = self.next()
            if var.kind != "var":
                self.fail()
            self.accept("AS")
            if self.at("TABLE"):
                raise TsqlError(50000, "Table variables are not implemented.")
            kind = self.type_name()
            value = self.expr() if self.op("=") else None
            self.accept("OUTPUT") or self.accept("OUT")  # in a parameter list
            items.append((var.text, kind, value))
            if not self.op(","):
                return Node("declare", items=items)

    def _set(self) -> Node:
        self.i += 1
        if self.now.kind == "var":
            var = self.next().text
            for op in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
                if self.op(op):
                    value = self.expr()
                    return Node("set", var=var, value=value if op == "=" else Node("binary", op=op[0], left=Node("var", name=var), right=value))
            self.fail()
        names = [self.next().text.upper()]
        if names[0] == "TRANSACTION":
            words = []
            while self.now.kind == "id" and self.now.word not in STATEMENTS:
                words.append(self.next().word)
            return Node("set_option", names=["TRANSACTION ISOLATION LEVEL"], value=" ".join(words[2:]))
        while self.op(","):
            names.append(self.next().text.upper())
        if names == ["IDENTITY_INSERT"]:
            table = self.dotted()
            return Node("set_option", names=names, value=self.next().text.upper(), table=table)
        value = self.next()
        text = value.text.upper()
        if text == "-":
            text += self.next().text
        return Node("set_option", names=names, value=text)

    def _if(self) -> Node:
        self.i += 1
        test = self.condition()
        then = self.statement()
        self.op(";")
        other = None
        if self.accept("ELSE"):
            other = self.statement()
        return Node("if", test=test, then=then, other=other)

    def _while(self) -> Node:
        self.i += 1
        return Node("while", test=self.condition(), body=self.statement())

    def _break(self) -> Node:
        self.i += 1
        return Node("break")

    def _continue(self) -> Node:
        self.i += 1
        return Node("continue")

    def _goto(self) -> Node:
        self.i += 1
        return Node("goto", name=self.name())

    def _return(self) -> Node:
        self.i += 1
        starts = self.now.kind in ("num", "var", "str") or self.is_op("(") or self.is_op("-")
        return Node("return", value=self.expr() if starts else None)

    def _print(self) -> Node:
        self.i += 1
        return Node("print", value=self.expr())

    def _use(self) -> Node:
        self.i += 1
        return Node("use", name=self.name())

    def _exec(self) -> Node:
        self.i += 1
        if self.op("("):
            text = self.expr()
            self.need(")")
            return Node("exec_text", text=text)
        return self._call()

    _execute = _exec

    def _call(self) -> Node:
        result = None
        if self.now.kind == "var" and self.is_op("=", 1):
            result = self.next().text
            self.i += 1
        proc = self.dotted()
        args = []
        while self.now.kind not in ("eof",) and not self.is_op(";") and self.now.word not in STATEMENTS and self.now.word not in ("ELSE", "END", "SELECT"):
            label = None
            if self.now.kind == "var" and self.is_op("=", 1):
                label = self.next().text
                self.i += 1
            if self.accept("DEFAULT"):
                value = None
            elif self.now.kind == "id" and self.now.word not in RESERVED and not self.is_op("(", 1):
                value = Node("lit", kind_="str", value=self.next().value)
            else:
                value = self.expr()
            out = self.accept("OUTPUT") or self.accept("OUT")
            args.append((label, value, out))
            if not self.op(","):
                break
        return Node("exec", proc=proc, args=args, result=result)

    def _truncate(self) -> Node:
        self.i += 1
        self.expect("TABLE")
        return Node("truncate", table=self.dotted())

    def _insert(self) -> Node:
        self.i += 1
        if self.at("TOP"):
            raise TsqlError(50000, "TOP in INSERT is not implemented.")
        self.accept("INTO")
        table = self.dotted()
        self.hints()
        columns = None
        if self.is_op("(") and self.peek().word != "SELECT":
            columns = self.names()
        if self.at("OUTPUT"):
            raise TsqlError(50000, "OUTPUT is not implemented.")
        if self.accept("DEFAULT", "VALUES"):
            return Node("insert", table=table, columns=columns, source=None)
        if self.at("EXEC") or self.at("EXECUTE"):
            raise TsqlError(50000, "INSERT ... EXEC is not implemented.")
        return Node("insert", table=table, columns=columns, source=self.query(default=True))

    def _update(self) -> Node:
        self.i += 1
        target = self.dotted()
        self.hints()
        self.expect("SET")
        sets = []
        while True:
            if self.now.kind == "var":
                raise TsqlError(50000, "SET @variable in UPDATE is not implemented.")
            column = self.dotted()[-1]
            op = self.next().text
            value = None if self.accept("DEFAULT") else self.expr()
            if op != "=":
                value = Node("binary", op=op[0], left=Node("col", parts=[column]), right=value)
            sets.append((column, value))
            if not self.op(","):
                break
        source = self.sources() if self.accept("FROM") else None
        return Node("update", target=target, sets=sets, source=source, where=self.condition() if self.accept("WHERE") else None)

    def _delete(self) -> Node:
        self.i += 1
        self.accept("FROM")
        target = self.dotted()
        self.hints()
        source = self.sources() if self.accept("FROM") else None
        return Node("delete", target=target, source=source, where=self.condition() if self.accept("WHERE") else None)

    def _create(self) -> Node:
        self.i += 1
        unique = self.accept("UNIQUE")
        clustered = self.accept("CLUSTERED")
        self.accept("NONCLUSTERED")
        if self.accept("INDEX"):
            name = self.name()
            self.expect("ON")
            table = self.dotted()
            columns = self.key_columns()
            include = self.names() if self.accept("INCLUDE") else []
            self.storage()
            return Node("create_index", name=name, table=table, columns=columns, unique=unique, clustered=clustered, include=include)
        if self.accept("DATABASE"):
            return Node("create_database", name=self.name())
        if self.accept("TABLE"):
            return self.create_table()
        if self.accept("SCHEMA"):
            return Node("create_schema", name=self.name())
        raise TsqlError(50000, f"CREATE {self.now.word} is not implemented.")

    def skip_parens(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            t = self.next()
            depth += (t.text == "(") - (t.text == ")")
            if t.kind == "eof":
                self.fail()

    def storage(self) -> None:
        """Options of where and how an index or table is kept: read and passed over."""
        while True:
            if self.at("WITH") and self.is_op("(", 1):
                self.i += 1
                self.skip_parens()
            elif self.now.word in ("ON", "TEXTIMAGE_ON") and self.peek().kind in ("qid",):
                self.i += 2
                if self.is_op("("):
                    self.skip_parens()
            else:
                return

    def key_columns(self) -> list[tuple[str, bool]]:
        self.need("(")
        out = []
        while True:
            name = self.name()
            out.append((name, self.accept("DESC") or (self.accept("ASC") and False)))
            if not self.op(","):
                self.need(")")
                return out

    def names(self) -> list[str]:
        self.need("(")
        out = [self.dotted()[-1]]
        while self.op(","):
            out.append(self.dotted()[-1])
        self.need(")")
        return out

    def create_table(self) -> Node:
        table = self.dotted()
        self.need("(")
        columns, constraints = [], []
        while True:
            if self.at("CONSTRAINT") or self.now.word in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                constraints.append(self.constraint(None))
            else:
                column, more = self.column()
                columns.append(column)
                constraints += more
            if not self.op(","):
                break
        self.need(")")
        self.storage()
        return Node("create_table", table=table, columns=columns, constraints=constraints)

    def column(self) -> tuple[Node, list[Node]]:
        name = self.name()
        if self.accept("AS"):
            value = self.expr()
            self.accept("PERSISTED")
            return Node("column", name=name, type=None, computed=value, nullable=True, identity=None), []
        kind = self.type_name()
        column, more = Node("column", name=name, type=kind, computed=None, nullable=None, identity=None), []
        while True:
            if self.accept("NOT", "NULL"):
                column.nullable = False
            elif self.accept("NULL"):
                column.nullable = True
            elif self.accept("IDENTITY"):
                seed, step = 1, 1
                if self.op("("):
                    seed = self.signed()
                    self.need(",")
                    step = self.signed()
                    self.need(")")
                column.identity = (seed, step)
            elif self.accept("COLLATE"):
                self.name()
            elif self.at("CONSTRAINT") or self.now.word in ("PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "DEFAULT", "FOREIGN"):
                more.append(self.constraint(name))
            else:
                return column, more

    def signed(self) -> int:
        minus = self.op("-")
        return int(self.next().text) * (-1 if minus else 1)

    def constraint(self, column: str | None) -> Node:
        name = self.name() if self.accept("CONSTRAINT") else None
        if self.accept("DEFAULT"):
            value = self.additive()
            return Node("default", name=name, value=value, column=self.name() if self.accept("FOR") else column)
        if self.accept("CHECK"):
            self.need("(")
            start = self.now.at
            test = self.condition()
            text = self.text[start : self.now.at].strip()
            self.need(")")
            return Node("check", name=name, test=test, text=text, column=column)
        kind = "primary" if self.accept("PRIMARY", "KEY") else "unique" if self.accept("UNIQUE") else None
        if kind:
            self.accept("CLUSTERED") or self.accept("NONCLUSTERED")
            columns = self.key_columns() if self.is_op("(") else [(column, False)]
            self.storage()
            return Node(kind, name=name, columns=columns)
        if self.accept("FOREIGN", "KEY"):
            own = self.names() if self.is_op("(") else [column]
        else:
            own = [column]
        self.expect("REFERENCES")
        parent = self.dotted()
        theirs = self.names() if self.is_op("(") else None
        while self.accept("ON"):
            self.i += 1
            self.accept("NO", "ACTION") or self.accept("CASCADE") or self.accept("SET", "NULL") or self.accept("SET", "DEFAULT")
        return Node("foreign", name=name, columns=own, parent=parent, parent_columns=theirs)

    def _alter(self) -> Node:
        self.i += 1
        if self.accept("DATABASE"):
            name = self.name()
            while self.now.kind not in ("eof",) and not self.is_op(";"):
                self.i += 1
            return Node("alter_database", name=name)
        self.expect("TABLE")
        table = self.dotted()
        if self.accept("WITH"):
            self.i += 1
        if self.accept("ADD"):
            columns, constraints = [], []
            while True:
                if self.at("CONSTRAINT") or self.now.word in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "DEFAULT"):
                    constraints.append(self.constraint(None))
                else:
                    column, more = self.column()
                    columns.append(column)
                    constraints += more
                if not self.op(","):
                    return Node("alter_add", table=table, columns=columns, constraints=constraints)
        if self.accept("DROP"):
            what = "constraint" if self.accept("CONSTRAINT") else "column" if self.accept("COLUMN") else "constraint"
            names = [self.name()]
            while self.op(","):
                names.append(self.name())
            return Node("alter_drop", table=table, what=what, names=names)
        raise TsqlError(50000, "This form of ALTER TABLE is not implemented.")

    def _drop(self) -> Node:
        self.i += 1
        what = self.next().word
        if what == "INDEX":
            exists = self.accept("IF", "EXISTS")
            name = self.dotted()
            table = self.dotted() if self.accept("ON") else name[:-1]
            return Node("drop_index", name=name[-1], table=table, exists=exists)
        if what not in ("TABLE", "DATABASE", "SCHEMA"):
            raise TsqlError(50000, f"DROP {what} is not implemented.")
        exists = self.accept("IF", "EXISTS")
        names = [self.dotted()]
        while self.op(","):
            names.append(self.dotted())
        return Node(f"drop_{what.lower()}", names=names, exists=exists)

    def _merge(self) -> Node:
        raise TsqlError(50000, "MERGE is not implemented.")

    def _throw(self) -> Node:
        raise TsqlError(50000, f"{self.now.word} is not implemented.")

    _raiserror = _waitfor = _grant = _deny = _revoke = _throw

    # -- queries -----------------------------------------------------------------------------------------------------
    def query(self, default: bool = False) -> Node:
        ctes = []
        if self.accept("WITH"):
            while True:
                name = self.name()
                columns = self.names() if self.is_op("(") else None
                self.expect("AS")
                self.need("(")
                ctes.append((name, columns, self.query()))
                self.need(")")
                if not self.op(","):
                    break
        body = self.set_operand(default)
        body = self.set_tail(body, 0)
        order = self.order_by() if self.at("ORDER", "BY") else []
        skip = fetch = None
        if self.accept("OFFSET"):
            skip = self.expr()
            self.accept("ROWS") or self.accept("ROW")
            if self.accept("FETCH"):
                self.accept("NEXT") or self.accept("FIRST")
                fetch = self.expr()
                self.accept("ROWS") or self.accept("ROW")
                self.expect("ONLY")
        if self.accept("FOR"):
            raise TsqlError(50000, "FOR XML and FOR JSON are not implemented.")
        if self.accept("OPTION"):
            self.skip_parens()
        return Node("query", body=body, order=order, ctes=ctes, skip=skip, fetch=fetch)

    def set_tail(self, left: Node, level: int) -> Node:
        """INTERSECT binds tighter than UNION and EXCEPT."""
        while True:
            if self.at("INTERSECT"):
                self.i += 1
                left = Node("set_op", op="INTERSECT", all=self.accept("ALL"), left=left, right=self.set_operand())
            elif level == 0 and (self.at("UNION") or self.at("EXCEPT")):
                op = self.next().word
                every = self.accept("ALL")
                left = Node("set_op", op=op, all=every, left=left, right=self.set_tail(self.set_operand(), 1))
            else:
                return left

    def set_operand(self, default: bool = False) -> Node:
        if self.op("("):
            inner = self.query()
            self.need(")")
            return inner.body if not (inner.order or inner.ctes or inner.skip) else inner
        if self.accept("VALUES"):
            return self.values(default)
        return self.select()

    def values(self, default: bool = False) -> Node:
        rows = []
        while True:
            self.need("(")
            row = []
            while True:
                row.append(None if default and self.accept("DEFAULT") else self.expr())
                if not self.op(","):
                    break
            self.need(")")
            rows.append(row)
            if not self.op(","):
                return Node("values", rows=rows)

    def order_by(self) -> list[tuple[Node, bool]]:
        self.expect("ORDER", "BY")
        keys = []
        while True:
            e = self.expr()
            keys.append((e, self.accept("DESC") or (self.accept("ASC") and False)))
            if not self.op(","):
                return keys

    def select(self) -> Node:
        self.expect("SELECT")
        distinct = self.accept("DISTINCT")
        self.accept("ALL")
        top = None
        if self.accept("TOP"):
            if self.op("("):
                count = self.expr()
                self.need(")")
            else:
                count = self.primary()
            percent = self.accept("PERCENT")
            top = Node("top", count=count, percent=percent, ties=self.accept("WITH", "TIES"))
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        into = self.dotted() if self.accept("INTO") else None
        source = self.sources() if self.accept("FROM") else None
        where = self.condition() if self.accept("WHERE") else None
        group = None
        if self.accept("GROUP", "BY"):
            if self.now.word in ("GROUPING", "ROLLUP", "CUBE"):
                raise TsqlError(50000, f"{self.now.word} is not implemented.")
            self.accept("ALL")
            group = [self.expr()]
            while self.op(","):
                group.append(self.expr())
        having = self.condition() if self.accept("HAVING") else None
        return Node("query_spec", distinct=distinct, top=top, items=items, into=into, source=source, where=where, group=group, having=having)

    def item(self) -> Node:
        if self.op("*"):
            return Node("star", prefix=[])
        if self.now.kind == "var" and self.is_op("=", 1):
            var = self.next().text
            self.i += 1
            return Node("assign", var=var, value=self.expr())
        if self.now.kind in ("id", "qid") and self.now.word not in RESERVED:
            k = 1
            while self.is_op(".", k):
                if self.is_op("*", k + 1):
                    prefix = [self.peek(j).value for j in range(0, k, 2)]
                    self.i += k + 2
                    return Node("star", prefix=prefix)
                k += 2
            if self.is_op("=", 1):
                name = self.name()
                self.i += 1
                return Node("item", value=self.expr(), name=name)
        value = self.expr()
        name = None
        if self.accept("AS"):
            name = self.next().value
        elif self.now.kind in ("qid", "str") or self.now.kind == "id" and self.now.word not in RESERVED and self.now.word not in STATEMENTS:
            name = self.next().value
        return Node("item", value=value, name=name)

    def sources(self) -> Node:
        left = self.joined()
        while self.op(","):
            left = Node("join", kind_="CROSS", left=left, right=self.joined(), on=None)
        return left

    def joined(self) -> Node:
        left = self.source()
        while True:
            if self.accept("CROSS", "JOIN"):
                left = Node("join", kind_="CROSS", left=left, right=self.source(), on=None)
                continue
            if self.at("CROSS", "APPLY") or self.at("OUTER", "APPLY"):
                outer = self.next().word == "OUTER"
                self.i += 1
                left = Node("apply", outer=outer, left=left, right=self.source())
                continue
            kind = None
            if self.accept("INNER"):
                kind = "INNER"
            elif self.now.word in ("LEFT", "RIGHT", "FULL") and not self.is_op("(", 1):
                kind = self.next().word
                self.accept("OUTER")
            if kind and self.now.word in ("HASH", "LOOP", "MERGE"):
                self.i += 1
            if not kind and not self.at("JOIN"):
                return left
            self.expect("JOIN")
            right = self.joined() if self.looks_nested() else self.source()
            self.expect("ON")
            left = Node("join", kind_=kind or "INNER", left=left, right=right, on=self.condition())

    def looks_nested(self) -> bool:
        """Whether another JOIN comes before this one's ON: ``a JOIN b JOIN c ON .. ON ..``."""
        depth, k = 0, 0
        while True:
            t = self.peek(k)
            if t.kind == "eof" or depth < 0:
                return False
            if t.kind == "op":
                depth += (t.text == "(") - (t.text == ")")
            elif depth == 0 and t.word == "JOIN":
                return True
            elif depth == 0 and t.word in ("ON", "WHERE", "GROUP", "ORDER", "SELECT"):
                return False
            k += 1

    def source(self) -> Node:
        if self.op("("):
            if self.at("SELECT") or self.at("VALUES") or self.at("WITH") or self.is_op("("):
                start = self.i
                try:
                    inner = self.query()
                    self.need(")")
                except TsqlError:
                    self.i = start
                    tree = self.sources()
                    self.need(")")
                    return tree
                alias, columns = self.alias(), None
                if alias and self.is_op("("):
                    columns = self.names()
                return Node("derived", query=inner, alias=alias, columns=columns)
            tree = self.sources()
            self.need(")")
            return tree
        if self.now.kind == "var":
            raise TsqlError(50000, "Table variables are not implemented.")
        parts = self.dotted()
        if self.is_op("("):
            if self.peek().word in HINTS and self.is_op(")", 2):
                self.i += 3
            else:
                raise TsqlError(215, f"Parameters supplied for object '{parts[-1]}' which is not a function.")
        alias = self.alias()
        self.hints()
        if alias is None:
            alias = self.alias()
        if self.now.word in ("PIVOT", "UNPIVOT"):
            raise TsqlError(50000, "PIVOT and UNPIVOT are not implemented.")
        return Node("table", parts=parts, alias=alias)

    def alias(self) -> str | None:
        if self.accept("AS"):
            return self.name()
        if self.now.kind == "qid" or self.now.kind == "id" and self.now.word not in RESERVED and self.now.word not in STATEMENTS and self.now.word not in ("OFFSET", "CROSS", "OUTER"):
            return self.name()
        return None

    def hints(self) -> None:
        """Table hints: read and left out, as there are no locks; two that name different levels are refused."""
        if self.at("WITH") and self.is_op("(", 1):
            self.i += 1
        elif not (self.is_op("(") and self.peek().word in HINTS):
            return
        begin = self.i
        self.skip_parens()
        levels = {LEVELS[t.word] for t in self.tokens[begin : self.i] if t.word in LEVELS}
        if len(levels) > 1:
            raise TsqlError(1047, "Conflicting locking hints specified.")

    # -- expressions -------------------------------------------------------------------------------------------------
    def condition(self) -> Node:
        e = self.boolean()
        if e.kind not in PREDICATES:
            self.fail(4145)
        return e

    def expr(self) -> Node:
        e = self.boolean()
        if e.kind in PREDICATES:
            self.fail()
        return e

    def boolean(self) -> Node:
        left = self.conjunction()
        while self.accept("OR"):
            left = Node("or", left=left, right=self.conjunction())
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.accept("AND"):
            left = Node("and", left=left, right=self.negation())
        return left

    def negation(self) -> Node:
        if self.accept("NOT"):
            return Node("not", value=self.negation())
        return self.predicate()

    def predicate(self) -> Node:
        if self.at("EXISTS"):
            self.i += 1
            self.need("(")
            q = self.query()
            self.need(")")
            return Node("exists", query=q)
        left = self.additive()
        if left.kind in PREDICATES:
            return left
        if self.now.kind == "op" and self.now.text in ("=", "<>", "!=", "<", "<=", ">", ">=", "!<", "!>"):
            op = {"!=": "<>", "!<": ">=", "!>": "<="}.get(self.now.text, self.now.text)
            self.i += 1
            if self.now.word in ("ALL", "ANY", "SOME"):
                every = self.next().word == "ALL"
                self.need("(")
                q = self.query()
                self.need(")")
                return Node("quantified", op=op, every=every, value=left, query=q)
            return Node("compare", op=op, left=left, right=self.additive())
        negated = self.at("NOT") and self.peek().word in ("IN", "LIKE", "BETWEEN")
        if negated:
            self.i += 1
        if self.accept("IN"):
            self.need("(")
            if self.at("SELECT") or self.at("WITH"):
                q = self.query()
                self.need(")")
                return Node("in_query", value=left, query=q, negated=negated)
            options = [self.expr()]
            while self.op(","):
                options.append(self.expr())
            self.need(")")
            return Node("in", value=left, options=options, negated=negated)
        if self.accept("LIKE"):
            pattern = self.additive()
            return Node("like", value=left, pattern=pattern, escape=self.additive() if self.accept("ESCAPE") else None, negated=negated)
        if self.accept("BETWEEN"):
            low = self.additive()
            self.expect("AND")
            return Node("between", value=left, low=low, high=self.additive(), negated=negated)
        if self.accept("IS"):
            negated = self.accept("NOT")
            self.expect("NULL")
            return Node("is_null", value=left, negated=negated)
        return left

    def additive(self) -> Node:
        left = self.signed_term()
        while self.now.kind == "op" and self.now.text in ("+", "-", "&", "|", "^"):
            op = self.next().text
            left = Node("binary", op=op, left=left, right=self.term())
        return left

    def signed_term(self) -> Node:
        if self.is_op("-") or self.is_op("+"):
            op = self.next().text
            value = self.signed_term()
            return Node("unary", op=op, value=value)
        return self.term()

    def term(self) -> Node:
        left = self.factor()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.next().text
            left = Node("binary", op=op, left=left, right=self.factor())
        return left

    def factor(self) -> Node:
        if self.now.kind == "op" and self.now.text in ("~", "-", "+"):
            op = self.next().text
            return Node("unary", op=op, value=self.factor())
        e = self.primary()
        while self.accept("COLLATE"):
            e = Node("collate", value=e, name=self.name())
        return e

    def type_name(self) -> tuple[str, list]:
        word = self.dotted()[-1] if self.now.kind == "qid" else self.next().text
        upper = word.upper()
        if upper == "DOUBLE":
            self.accept("PRECISION")
        if upper == "NATIONAL":
            word = "n" + self.next().text
            upper = word.upper()
        if upper in ("CHARACTER", "CHAR", "NCHAR", "NCHARACTER") and self.accept("VARYING"):
            word = "nvarchar" if upper.startswith("N") else "varchar"
        word = "nchar" if upper == "NCHARACTER" else word
        args = []
        if self.op("("):
            while True:
                t = self.next()
                args.append("max" if t.word == "MAX" else t.text)
                if not self.op(","):
                    break
            self.need(")")
        return word, args

    def primary(self) -> Node:
        t = self.now
        if t.kind == "num":
            self.i += 1
            return Node("lit", kind_="num", value=t.text)
        if t.kind == "str":
            self.i += 1
            return Node("lit", kind_="nstr" if t.text[0] in "nN" else "str", value=t.value)
        if t.kind in ("bin", "money"):
            self.i += 1
            return Node("lit", kind_=t.kind, value=t.text)
        if t.kind == "var":
            self.i += 1
            return Node("var", name=t.text)
        if self.op("("):
            if self.at("SELECT") or self.at("WITH"):
                q = self.query()
                self.need(")")
                return Node("scalar", query=q)
            e = self.boolean()
            self.need(")")
            return e
        w = t.word
        if w == "NULL":
            self.i += 1
            return Node("lit", kind_="null", value=None)
        if w == "CASE":
            return self.case()
        if w in ("CAST", "TRY_CAST") and self.is_op("(", 1):
            self.i += 2
            value = self.expr()
            self.expect("AS")
            kind = self.type_name()
            self.need(")")
            return Node("cast", value=value, type=kind, style=None, try_=w == "TRY_CAST")
        if w in ("CONVERT", "TRY_CONVERT") and self.is_op("(", 1):
            self.i += 2
            kind = self.type_name()
            self.need(",")
            value = self.expr()
            style = self.expr() if self.op(",") else None
            self.need(")")
            return Node("cast", value=value, type=kind, style=style, try_=w == "TRY_CONVERT")
        if w == "IIF" and self.is_op("(", 1):
            self.i += 2
            test = self.condition()
            self.need(",")
            yes = self.expr()
            self.need(",")
            no = self.expr()
            self.need(")")
            return Node("case", value=None, arms=[(test, yes)], other=no)
        if w in ("CURRENT_TIMESTAMP", "CURRENT_USER", "SESSION_USER", "SYSTEM_USER", "USER") and not self.is_op("(", 1):
            self.i += 1
            return Node("call", name=w, args=[], distinct=False, star=False, over=None)
        if (t.kind == "id" and (w not in RESERVED or w in ("LEFT", "RIGHT", "NULLIF")) or t.kind == "qid") and self.is_op("(", 1):
            self.i += 2
            star = self.op("*")
            distinct = self.accept("DISTINCT")
            self.accept("ALL")
            args = []
            while not star and not self.is_op(")"):
                args.append(self.expr())
                if not self.op(","):
                    break
            self.need(")")
            return Node("call", name=t.value.upper(), args=args, distinct=distinct, star=star, over=self.over() if self.accept("OVER") else None)
        if t.kind in ("id", "qid"):
            return Node("col", parts=self.dotted())
        self.fail()

    def over(self) -> Node:
        self.need("(")
        parts, order, frame = [], [], None
        if self.accept("PARTITION", "BY"):
            parts = [self.expr()]
            while self.op(","):
                parts.append(self.expr())
        if self.at("ORDER", "BY"):
            order = self.order_by()
        if self.now.word in ("ROWS", "RANGE"):
            words = []
            while not self.is_op(")"):
                words.append(self.next().text.upper())
            frame = " ".join(words)
        self.need(")")
        return Node("over", parts=parts, order=order, frame=frame)

    def case(self) -> Node:
        self.i += 1
        value = None if self.at("WHEN") else self.expr()
        arms = []
        while self.accept("WHEN"):
            test = self.condition() if value is None else Node("compare", op="=", left=value, right=self.expr())
            self.expect("THEN")
            arms.append((test, self.expr()))
        other = self.expr() if self.accept("ELSE") else None
        self.expect("END")
        if not arms:
            self.fail()
        return Node("case", value=None, arms=arms, other=other)


STATEMENTS = set(
    "WITH BEGIN COMMIT ROLLBACK SAVE DECLARE SET IF WHILE BREAK CONTINUE GOTO RETURN PRINT USE EXEC EXECUTE TRUNCATE INSERT UPDATE DELETE CREATE ALTER DROP MERGE THROW RAISERROR WAITFOR GRANT DENY REVOKE SELECT".split()
)


def parse(text: str) -> list[Node]:
    """The statements of a batch; a syntax error anywhere voids it."""
    return Parser(text).batch()
