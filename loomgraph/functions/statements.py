"""SQL statements read off their tokens, and names read off their words; Column builders only.

A statement is cut once into comments, literals, quoted names, words and signs. What it does, the tables it names, and whether it takes
many rows or tests the state it changes, follow from tokens and their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a comment, a literal, a name in any of three quotes, a word, a number, or a sign.
TOKEN = r"""--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|'[^']*'|"[^"]*"|`[^`]*`|\[[^\]]*\]|\w[\w$]*|\S"""
#: One word of a name: an abbreviation, a word with or without a capital, digits.
WORD = r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*|[0-9]+"
# Stems of words that check who is asking.
AUTH_STEMS = ("auth", "verif", "permission", "access", "allowed", "entitle", "role", "member", "employee", "session", "token", "signature", "credential")


def tokens(text: Column) -> Column:
    """The tokens of a statement, words in small letters, without comments."""
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)
    solid = F.filter(found, lambda t: ~(t.startswith("--") | t.startswith("/*")))
    return F.transform(solid, lambda t: F.when(t.rlike(r"^\w"), F.lower(t)).otherwise(t))


def of_tokens(text: Column, f: Callable[[Column], Column]) -> Column:
    """f of a statement's tokens, which are cut once: the only element of an array, under the name that a lambda gives it."""
    return F.get(F.transform(F.array(tokens(text)), f), F.lit(0))


def _is_name(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^([a-z_]|[\"`\[])") & (F.length(t) > 0) & ~t.isin("select", "set", "lateral", "only", "from"), F.lit(False))


def _at(t: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(t, i))


def _places(t: Column) -> Column:
    return F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))


def statement_verb(t: Column) -> Column:
    """The word that says what a statement does: its first, or the one after the definitions of a WITH."""
    first = F.get(t, F.lit(0))
    after = F.filter(_places(t), lambda i: _at(t, i).isin("select", "insert", "update", "delete", "merge") & (_at(t, i - 1) == ")"))
    return F.when(first == "with", F.get(t, F.get(after, F.lit(0)))).otherwise(first)


def statement_operation(t: Column) -> Column:
    """read, write or delete; null for all else."""
    verb = statement_verb(t)
    return F.when(verb == "select", "read").when(verb.isin("insert", "update"), "write").when(verb.isin("delete", "truncate"), "delete")


def _defined(t: Column) -> Column:
    """Names that a WITH defines: NAME AS (, or NAME (columns) AS (."""
    def opens(i: Column) -> Column:
        return (_at(t, i) == "as") & _at(t, i + 1).isin("(", "materialized", "not")

    def closed(i: Column) -> Column:
        return i + F.array_position(F.slice(t, i + 1, F.size(t)), ")").cast("int")

    begins = lambda i: _at(t, i - 1).isin("with", "recursive", ",") & _is_name(_at(t, i))
    found = F.filter(_places(t), lambda i: begins(i) & (opens(i + 1) | ((_at(t, i + 1) == "(") & opens(closed(i + 1)))))
    return F.transform(found, lambda i: _bare(_at(t, i)))


def _bare(name: Column) -> Column:
    return F.lower(F.translate(name, '"`[]', ""))


def statement_tables(t: Column) -> Column:
    """Tables that a statement names, in small letters, without quotes and schema, less what its WITH defines; sorted."""
    def named_next(i: Column) -> Column:
        before, word, after = _at(t, i - 1), _at(t, i), _at(t, i + 1)
        plain = word.isin("from", "join") | ((word == "into") & (before == "insert")) | ((word == "table") & (before == "truncate"))
        alone = (word == "truncate") & (after != "table") | (word == "update") & ~F.coalesce(before.isin("for", "do", "on", "key"), F.lit(False))
        return F.coalesce(plain | alone, F.lit(False)) & _is_name(after)

    def last(i: Column) -> Column:
        """The last part of a dotted name that begins at i."""
        two = (_at(t, i + 1) == ".") & _is_name(_at(t, i + 2))
        three = two & (_at(t, i + 3) == ".") & _is_name(_at(t, i + 4))
        return F.when(three, _at(t, i + 4)).when(two, _at(t, i + 2)).otherwise(_at(t, i))

    found = F.transform(F.filter(_places(t), named_next), lambda i: _bare(last(i + 1)))
    return F.sort_array(F.array_distinct(F.array_except(F.filter(found, lambda x: x != ""), _defined(t))))


def statement_is_batch(t: Column) -> Column:
    """Whether it takes many rows at once: a list, an array, or an insert of several rows."""
    listed = F.exists(_places(t), lambda i: _at(t, i).isin("in", "any", "unnest") & (_at(t, i + 1) == "("))
    rows = F.exists(_places(t), lambda i: (_at(t, i) == ")") & (_at(t, i + 1) == ",") & (_at(t, i + 2) == "("))
    return F.coalesce(listed, F.lit(False)) | (F.array_contains(t, "values") & F.coalesce(rows, F.lit(False)))


def statement_is_conditional(t: Column) -> Column:
    """Whether an update changes a row only in the state it expects, or hands it back."""
    where = F.array_position(t, "where").cast("int") - 1

    def tested(i: Column) -> Column:
        sign = F.when(_at(t, i + 2) == ".", _at(t, i + 4)).otherwise(_at(t, i + 2))
        return (i > where) & (_at(t, i) == "and") & sign.isin("=", "<", "!", "is", "in")

    state = (where >= 0) & F.exists(_places(t), tested)
    return (F.get(t, F.lit(0)) == "update") & (F.coalesce(state, F.lit(False)) | F.array_contains(t, "returning"))


def name_words(name: Column) -> Column:
    """The words of a name in order, case kept."""
    return F.regexp_extract_all(name, F.lit(f"({WORD})"), 1)


def checks_who_asks(name: Column) -> Column:
    """Whether a word of the name begins with the stem of a check."""
    stems = F.array(*[F.lit(x) for x in AUTH_STEMS])
    return F.exists(F.transform(name_words(name), lambda w: F.lower(w)), lambda w: F.exists(stems, lambda s: w.startswith(s)))


def name_role(name: Column) -> Column:
    """webhook, callback or probe by the last word of a name (with a capital, or alone), or by its first two; else null."""
    w = name_words(name)
    last, first, second = F.try_element_at(w, F.lit(-1)), F.get(w, F.lit(0)), F.get(w, F.lit(1))
    alone = F.size(w) == 1
    ends = lambda *x: last.isin(*[y.capitalize() for y in x]) | (alone & last.isin(*x))
    webhook = ends("webhook", "webhooks") | ((first == "handle") & (second == "Webhook"))
    callback = ends("callback", "callbacks") | ((first == "on") & (second == "Callback"))
    health = (last == "Controller") & (F.try_element_at(w, F.lit(-2)) == "Health")
    return F.when(webhook, "webhook").when(callback, "callback").when(ends("probe") | health, "probe")
