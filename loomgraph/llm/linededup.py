"""Line dedup (op12): lines that many documents share stay in one of them; DataFrame functions only.

Normalised lines are exploded and hashed, the documents of each hash are counted, and lines over the threshold leave every document
but the one with the smallest id. Only hashes are shuffled for that; each text is split again where it is put together from the
positions of the lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, PRE, join_counted, materialise, sized, table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
H, ROW, POS, DROP = f"{PRE}h", f"{PRE}row", f"{PRE}pos", f"{PRE}drop"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at its ends and with small letters for A-Z; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def digest(c: Column) -> Column:
    """The first 16 bytes of SHA-256: no text can be built to meet another's by chance or on purpose."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def row_key(doc: str, text: str) -> Column:
    return digest(F.concat(F.coalesce(F.col(doc).cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))


def shared_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_documents: int = 2, least_chars: int = 10) -> DataFrame:
    """(hash, n documents, smallest id) of the normalised lines that at least `least_documents` documents hold.

    A document counts once a line, however often it holds it; sums are made before the shuffle, so a line that all documents hold
    is one row of each task there.
    """
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines_of(F.col(text)), key_of), lambda k: F.length(k) >= least_chars), digest))
    found = docs.select(F.col(doc).alias(f"{PRE}doc"), F.explode(keys).alias(H))
    counted = found.groupBy(H).agg(F.count("*").alias(f"{PRE}n"), F.min(f"{PRE}doc").alias(f"{PRE}first"))
    return counted.filter((F.col(f"{PRE}n") >= least_documents) & F.col(f"{PRE}first").isNotNull())


def dedup_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", least_documents: int = 2, least_chars: int = 10, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """docs with the lines that stay as `text`, and n_lines (before) and n_dropped (longs).

    Every row is a document. A row with a null id comes after all others; rows of one id all count as the first that holds a line
    when theirs is the smallest id, and then all keep it. Null texts have one empty line and stay null; a text that loses all its
    lines is empty. Repeated rows give repeated results. Other columns stay; columns called n_lines or n_dropped are replaced. An
    empty table gives none. A row's dropped positions are one value, as long as the row's own lines.
    """
    shared = materialise(shared_lines(docs, doc, text, least_documents, least_chars), "lines")
    own = docs.select(F.col(doc).alias(f"{PRE}doc"), row_key(doc, text).alias(ROW), F.posexplode(lines_of(F.col(text))).alias(POS, f"{PRE}line"))
    own = own.withColumn(f"{PRE}key", key_of(F.col(f"{PRE}line"))).filter(F.length(f"{PRE}key") >= least_chars)
    own = own.select(f"{PRE}doc", ROW, POS, digest(F.col(f"{PRE}key")).alias(H))
    met = join_counted(own, shared, H, f"{PRE}n", F.struct(ROW, POS), 64, broadcast_bytes)
    late = met.filter(F.col(f"{PRE}doc").isNull() | (F.col(f"{PRE}doc") > F.col(f"{PRE}first")))
    # a set: repeated rows have the same positions
    drops = materialise(late.groupBy(ROW).agg(F.collect_set(POS).alias(DROP)), "drops")
    size = drops.agg(F.count("*"), F.sum(F.size(DROP))).first()
    drops = sized(drops, size[0] * 64 + (size[1] or 0) * 8, 1, broadcast_bytes)
    joined = docs.withColumn(ROW, row_key(doc, text)).join(drops, ROW, "left")
    lines = lines_of(F.col(text))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(DROP))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    cols = [F.when(F.col(DROP).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*cols, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(DROP), F.lit(0)).cast("long").alias("n_dropped"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), m as (
  select k.*, f.key is not null and k.doc_id > f.first as gone from k left join f on k.key = f.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
