"""SQL spelling of what the expressions need, for Spark and, for oracles, DuckDB."""

from __future__ import annotations

import re
from collections.abc import Iterable


class Dialect:
    """Text functions take SQL text and return SQL text. Regular expressions must be valid in both engines (ASCII, no look-around)."""

    #: Whether the words of clauses have been looked up: terms.Seeing.
    sees = False

    def text(self, value: str | None) -> str:
        raise NotImplementedError

    def spread(self, keys: str) -> str:
        """Opens the list of a SELECT whose rows are to be spread evenly over tasks."""
        return ""

    def any_of(self, x: str, words: Iterable[str]) -> str:
        """Whether x contains one of the words, as it stands."""
        return self.matches(x, "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words))

    def case(self, pairs: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
        pairs = list(pairs)
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END" if pairs else otherwise

    def lookup(self, x: str, table: dict[str, str], otherwise: str = "NULL") -> str:
        return f"CASE {x} " + " ".join(f"WHEN {self.text(k)} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"

    def one_of(self, x: str, values: Iterable[str]) -> str:
        return f"{x} IN (" + ", ".join(self.text(v) for v in values) + ")"


class _Spark(Dialect):
    """Long CASEs stand in a lambda: Spark evaluates these without generating code for them, which would else outgrow what the JVM compiles, and what it optimises."""

    name = "spark"
    #: Stands for the number of tasks until the size of the tables is known.
    TASKS = "999999999"

    def spread(self, keys):
        return f"/*+ REPARTITION({self.TASKS}, {keys}) */ "

    def case(self, pairs, otherwise="NULL"):
        pairs = list(pairs)
        body = super().case(pairs, otherwise)
        return self.let("0", "any_", body) if len(pairs) > 6 else body

    def lookup(self, x, table, otherwise="NULL"):
        return self.let(x, "key_", super().lookup("key_", table, otherwise)) if len(table) > 6 else super().lookup(x, table, otherwise)

    def text(self, value):
        return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def any_of(self, x, words):
        return "(" + " OR ".join(f"contains({x}, {self.text(w)})" for w in words) + ")"

    def matches(self, x, pattern):
        return f"regexp_like({x}, {self.text(pattern)})"

    def extract(self, x, pattern, group=0):
        """The group of the first match, NULL if there is none or it is empty."""
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {group}), '')"

    def extract_all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def strings(self, values):
        return "array(" + ", ".join(self.text(v) for v in values) + ")" if values else "CAST(array() AS ARRAY<STRING>)"

    def count_in(self, x, words):
        return "size(array_remove(array(" + ", ".join(f"contains({x}, {self.text(w)})" for w in words) + "), false))"

    def sorted_set(self, x):
        return f"array_join(array_sort(array_distinct({x})), ',')"

    def ordered_set(self, x, most=None):
        """Distinct strings that aren't empty, in order of their first place, the first `most` of them, joined."""
        kept = f"array_distinct(filter({x}, e_ -> e_ <> ''))"
        return f"array_join({f'slice({kept}, 1, {most})' if most else kept}, ', ')"

    def map_strings(self, x, name, body):
        return f"transform({x}, {name} -> {body})"

    def chain(self, *lists):
        return "concat(" + ", ".join(lists) + ")"

    def let(self, x, name, body):
        """body with name standing for x, which is worked out once."""
        return f"element_at(transform(array({x}), {name} -> {body}), 1)"

    def barrier(self, query, columns):
        """query, computed before any filter above it: Spark would else copy long expressions into each pushed predicate."""
        fields = ", ".join(f"'{c}', {c}" for c in columns)
        return f"SELECT inline(array(named_struct({fields}))) FROM ({query})"

    def last_value(self, x, over):
        return f"last({x}, true) OVER ({over})"

    def keep_strings(self, x, name, test):
        return f"filter({x}, {name} -> {test})"

    def first_strings(self, x, most):
        return f"array_join(slice({x}, 1, {most}), ' | ')"

    def words(self, x):
        return f"filter(split(trim({x}), '\\\\s+'), w -> w <> '')"

    def size(self, x):
        return f"size({x})"

    def lines(self, x):
        return f"split({x}, '\\n')"

    def number(self, x, kind="BIGINT"):
        return f"try_cast({x} AS {'DOUBLE' if kind == 'DOUBLE' else kind})"

    def pick(self, values, index):
        return f"element_at({self.strings(values)}, CAST({index} AS INT) + 1)"

    def concat_lines(self, x, order):
        return f"listagg({x}, '\\n') WITHIN GROUP (ORDER BY {order})"

    def explode_lines(self, table, keys, x):
        return f"SELECT {keys}, pos, line FROM {table} LATERAL VIEW posexplode(split({x}, '\\n')) e AS pos, line"

    def date_text(self, x):
        return f"date_format({x}, 'dd.MM.yyyy')"


class _Duck(Dialect):
    name = "duckdb"

    def text(self, value):
        return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def extract(self, x, pattern, group=0):
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {group}), '')"

    def extract_all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(re.sub(r'[$](\d)', lambda m: chr(92) + m[1], by))}, 'g')"

    def strings(self, values):
        return "[" + ", ".join(self.text(v) for v in values) + "]::VARCHAR[]"

    def count_in(self, x, words):
        return f"len(list_filter({self.strings(words)}, lambda k: contains({x}, k)))"

    def sorted_set(self, x):
        return f"array_to_string(list_sort(list_distinct({x})), ',')"

    def ordered_set(self, x, most=None):
        kept = "list_filter(all_, lambda e_, i_: e_ <> '' AND list_position(all_, e_) = i_)"
        return self.let(x, "all_", f"array_to_string({f'{kept}[1:{most}]' if most else kept}, ', ')")

    def map_strings(self, x, name, body):
        return f"list_transform({x}, lambda {name}: {body})"

    def chain(self, *lists):
        return "(" + " || ".join(lists) + ")"

    def let(self, x, name, body):
        return f"list_transform([{x}], lambda {name}: {body})[1]"

    def barrier(self, query, columns):
        return f"SELECT {', '.join(columns)} FROM ({query})"

    def last_value(self, x, over):
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def keep_strings(self, x, name, test):
        return f"list_filter({x}, lambda {name}: {test})"

    def first_strings(self, x, most):
        return f"array_to_string(({x})[1:{most}], ' | ')"

    def words(self, x):
        return f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"

    def size(self, x):
        return f"len({x})"

    def lines(self, x):
        return f"string_split({x}, chr(10))"

    def number(self, x, kind="BIGINT"):
        return f"try_cast({x} AS {kind})"

    def pick(self, values, index):
        return f"({self.strings(values)})[CAST({index} AS INT) + 1]"

    def concat_lines(self, x, order):
        return f"string_agg({x}, chr(10) ORDER BY {order})"

    def explode_lines(self, table, keys, x):
        return f"SELECT {keys}, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT *, string_split({x}, chr(10)) AS l FROM {table})"

    def date_text(self, x):
        return f"strftime({x}, '%d.%m.%Y')"


SPARK, DUCK = _Spark(), _Duck()
