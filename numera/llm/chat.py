"""Chat formatting as a prefix tree.

A turn is a node of the tree, named by all turns up to it, so conversations that begin alike share nodes. The tree is
laid out depth-first as one stream of tokens in which each node occurs once. A node knows the position of its tokens
within a conversation, and the intervals of the stream that its ancestors fill: what its tokens may attend to besides
themselves. Sorting conversations by their paths gives the depth-first order: a node belongs to the first conversation
that passes through it, and a conversation's own nodes follow each other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table
from .tokenize import encoder

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
#: Tokens of the stream to a block; it decides speed only.
BLOCK = 512


def escape(c: Column) -> Column:
    r"""\ becomes \\, and <| becomes <\|: no control string is left, and unescape() gives the text back."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return "\\".join(part.replace("<\\|", "<|") for part in text.split("\\\\"))


def segment(role: Column, text: Column) -> Column:
    """A turn as it stands in the stream. A role's line ends are escaped too, as the first one ends it."""
    own = F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), own, F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END + "\n"))


def parse(formatted: str) -> tuple[str, str, int, int]:
    """Of one segment: role, text, and where the text stands in it (escaped)."""
    assert formatted.startswith(START) and formatted.endswith(END + "\n"), formatted[:40]
    at = formatted.index("\n")
    role = "\\".join(p.replace("<\\|", "<|").replace("\\n", "\n") for p in formatted[len(START) : at].split("\\\\"))
    end = len(formatted) - len(END) - 1
    return role, unescape(formatted[at + 1 : end]), at + 1, end


@dataclass
class Tree:
    """nodes: k1, k2 (its name), depth, role, ids (binary, little-endian unsigned 32-bit), n_tokens, loss_from, loss_to (its
    tokens under the loss mask: those of a learnt text), stream_start, position_start, ancestors (array of from, to in the stream). members: conv_id, order, depth, k1, k2."""

    nodes: DataFrame
    members: DataFrame


def _encode(path: str):
    def batches(it):
        import pyarrow as pa

        ids, at = encoder(path).ids, 0
        tail = ids(END + "\n")
        for b in it:
            made, learnt = [], []
            # head, text and tail are encoded one by one, so that the loss mask starts and ends between tokens
            for s, role in zip(b.column("segment").to_pylist(), b.column("role").to_pylist()):
                cut = s.index("\n") + 1
                head, text = ids(s[:cut]), ids(s[cut : len(s) - len(END) - 1])
                made.append(head + text + tail)
                learnt.append((len(head) // 4, (len(head) + len(text)) // 4) if role == LEARNT_ROLE else (0, 0))
            starts = []
            for x in made:
                starts.append(at)
                at += len(x) // 4
            keep = [b.column(c) for c in ("k1", "k2", "owner", "depth", "role", "_part")]
            own = [pa.array(made, pa.binary()), pa.array([len(x) // 4 for x in made], pa.int64()), *(pa.array([x[k] for x in learnt], pa.int64()) for k in (0, 1)), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*keep, *own], ["k1", "k2", "owner", "depth", "role", "_part", "ids", "n_tokens", "loss_from", "loss_to", "_start"])

    return batches


def _attend(it):
    """Rows come by conversation and depth; only the open runs of the present conversation are held."""
    import pyarrow as pa

    order = None
    runs: list[list[int]] = []
    place, last = 0, None
    for b in it:
        out: dict[str, list] = {k: [] for k in ("k1", "k2", "position_start", "ancestors")}
        for r in b.to_pylist():
            if r["order"] != order:
                order, runs, place, last = r["order"], [], 0, None
            if r["owner"] == order:
                out["k1"].append(r["k1"]), out["k2"].append(r["k2"]), out["position_start"].append(place)
                out["ancestors"].append([{"from": a, "to": z} for a, z in runs])
            to = r["stream_start"] + r["n_tokens"]
            if last == r["owner"] and runs[-1][1] == r["stream_start"]:
                runs[-1][1] = to
            else:
                runs.append([r["stream_start"], to])
            last, place = r["owner"], place + r["n_tokens"]
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int64()), pa.array(out["position_start"], pa.int64()), pa.array(out["ancestors"], kind)], list(out))


def prefix_tree(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    """The tree of all conversations; see Tree.

    Rows are ordered by turn; rows of one turn by role, then text, nulls first, and repeated rows are as many turns.
    Null roles and texts are empty ones. Rows without a conversation id form one conversation. A conversation's path (16
    bytes a turn) is held in one row. Other columns are left out. An empty table gives empty results.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(by)).withColumn("segment", segment(F.col("role"), F.col("text")))
    so_far = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"k{i}": F.bit_xor(F.xxhash64(F.lit(i), "depth", "segment")).over(so_far) for i in (1, 2)})
    rows = materialize(rows.select("conv_id", "depth", F.coalesce("role", F.lit("")).alias("role"), "segment", "k1", "k2"), "turns")

    path = F.transform(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2"))), lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2")))
    convs = materialize(rows.groupBy("conv_id").agg(path.alias("path")), "paths")
    convs = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("order", F.monotonically_increasing_id())
    convs = materialize(convs, "convs")
    members = convs.select("conv_id", "order", F.posexplode("path").alias("depth", "k")).select("conv_id", "order", "depth", "k.k1", "k.k2")

    names = ["k1", "k2"]
    owners = members.groupBy(names).agg(F.min("order").alias("owner"))
    nodes = rows.groupBy(names).agg(F.any_value("depth").alias("depth"), F.any_value("role").alias("role"), F.any_value("segment").alias("segment")).join(owners, names)
    nodes = nodes.repartitionByRange(parts, "owner", "depth").sortWithinPartitions("owner", "depth").withColumn("_part", F.spark_partition_id())
    nodes = nodes.mapInArrow(_encode(tokenizer), "k1 long, k2 long, owner long, depth int, role string, _part int, ids binary, n_tokens long, loss_from long, loss_to long, _start long")
    nodes = materialize(nodes, "nodes")
    # the ranges follow each other in the stream: one row a range
    ends, at = [], 0
    for r in sorted(nodes.groupBy("_part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["_part"]):
        ends.append((r["_part"], at))
        at += r["n"]
    shift = spark.createDataFrame(ends, "_part int, _before long")
    nodes = nodes.join(F.broadcast(shift), "_part").withColumn("stream_start", F.col("_start") + F.col("_before")).drop("_part", "_start", "_before")
    walked = members.join(nodes.select("k1", "k2", "owner", "stream_start", "n_tokens"), names).repartition(parts, "order").sortWithinPartitions("order", "depth")
    seen = walked.mapInArrow(_attend, "k1 long, k2 long, position_start long, ancestors array<struct<from: long, to: long>>")
    return Tree(materialize(nodes.join(seen, names), "tree"), members)


def _read_back(path: str):
    def batches(it):
        import numpy as np
        import pyarrow as pa

        decode = encoder(path).decode
        order, state, done = None, None, []

        def close():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch():
            columns = list(zip(*done)) or [()] * 6
            kinds = (conv_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return made

        conv_kind = pa.int64()
        for b in it:
            conv_kind = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if r["order"] != order:
                    close()
                    order, state = r["order"], [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = np.frombuffer(r["ids"], "<u4")
                assert r["position_start"] == state[6], "the intervals of a conversation leave a gap"
                formatted = decode(ids.tolist())
                role, text, _, _ = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if r["loss_to"] > r["loss_from"]:
                    learnt = unescape(decode(ids[r["loss_from"] : r["loss_to"]].tolist()))
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(formatted)
                state[6] += len(ids)
            yield batch()
        close()
        yield batch()

    return batches


def read_back(tree: Tree, tokenizer: str) -> DataFrame:
    """Each conversation as its last node attends to it: the tokens of the stream in the intervals of the node's ancestors
    and its own, by position. Digests of its turns and of what stands under the loss mask."""
    parts = int(tree.members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = tree.members.groupBy("conv_id", "order").agg(F.max(F.struct("depth", "k1", "k2")).alias("x")).select("conv_id", "order", "x.k1", "x.k2")
    own = F.array(F.struct(F.col("stream_start").alias("from"), (F.col("stream_start") + F.col("n_tokens")).alias("to")))
    runs = last.join(tree.nodes.select("k1", "k2", F.concat("ancestors", own).alias("runs")), ["k1", "k2"]).select("conv_id", "order", F.explode("runs").alias("r"))
    # an interval meets the nodes that begin in it by blocks of the stream
    block = lambda c: F.floor(c / BLOCK)
    runs = runs.select("conv_id", "order", "r.from", "r.to", F.explode(F.sequence(block(F.col("r.from")), block(F.col("r.to") - 1))).alias("block"))
    nodes = tree.nodes.select(block(F.col("stream_start")).alias("block"), "stream_start", "position_start", "loss_from", "loss_to", "ids")
    rows = runs.join(nodes, "block").where((F.col("stream_start") >= F.col("from")) & (F.col("stream_start") < F.col("to")))
    rows = rows.select("conv_id", "order", "position_start", "loss_from", "loss_to", "ids").repartition(parts, "order").sortWithinPartitions("order", "position_start")
    return rows.mapInArrow(_read_back(tokenizer), f"conv_id {tree.members.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_back(prefix_tree(given.unionByName(own), path), path)


#: What the digest columns have to be, straight from the rows.
OP4_SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars FROM escaped GROUP BY conv_id
"""
