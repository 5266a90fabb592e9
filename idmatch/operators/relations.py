"""Identity tables: keyed lookups, delta sync, outbox and table changes as pure transforms.

Lookups are plain equi-joins: Spark broadcasts a side only when its known size is under the session's
limit, and splits skewed partitions at run time otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States and limits of the stored tables.
ACTIVE, INACTIVE = "activo", "desactivado"
USE_LIMIT = 150
CREDENTIAL_STATES = ("activo", "inactivo")
RESET_TABLES = (
    "credenciales_biometricas", "validaciones_biometricas", "textos_dinamicos_audio", "usuarios",
)
RESET_CASCADE = ("caracteristicas_hablantes", "caracteristicas_oreja")  # children emptied with their parents

PUSH_ITEM = T.StructType([
    T.StructField("id_usuario", T.IntegerType()), T.StructField("id_credencial", T.IntegerType()),
    T.StructField("vector_features", T.ArrayType(T.DoubleType())), T.StructField("dimension", T.IntegerType()),
])


def spread(df: DataFrame, *keys: str, rows_per_task: int = 20_000) -> DataFrame:
    """Hash-partitions rows that are small in bytes but costly to process, so that every core gets some.

    Size-based coalescing would put them into few tasks. A join on the same keys reuses the partitioning
    when both sides are spread alike.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows_per_task + 1)
    return df.repartition(tasks, *keys)


def lookup_user(users: DataFrame, column: str, value) -> DataFrame:
    return users.filter(F.col(column) == value)


def active_credentials(credentials: DataFrame, modality: str, user_column: str = "id_usuario", user=None,
                       modality_column: str = "tipo_biometria", state_column: str = "estado",
                       active: str = ACTIVE) -> DataFrame:
    kept = credentials.filter((F.col(modality_column) == modality) & (F.col(state_column) == active))
    return kept if user is None else kept.filter(F.col(user_column) == user)


def changes_since(df: DataFrame, since, column: str = "updated_at") -> DataFrame:
    """Rows changed after the mark (strictly); everything when the mark is empty."""
    return df if since is None else df.filter(F.col(column) > F.lit(since))


def high_water(df: DataFrame, column: str = "updated_at") -> DataFrame:
    return df.agg(F.max(column).alias("high_water"), F.count("*").alias("n"))


def project_with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Listed columns; a missing column or null value gets the default (None keeps null)."""
    def pick(name, default):
        if name not in df.columns:
            return F.lit(default).alias(name)
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default)).alias(name)

    return df.select(*[pick(n, d) for n, d in defaults.items()])


def eligible_phrases(phrases: DataFrame, state: str = "estado_texto", uses: str = "contador_usos",
                     limit: str = "limite_usos") -> DataFrame:
    """Active phrases under their limit of uses; a missing count is 0, a missing limit the default."""
    left = F.coalesce(F.col(uses), F.lit(0)) < F.coalesce(F.col(limit), F.lit(USE_LIMIT))
    return phrases.filter((F.col(state) == ACTIVE) & left)


def parse_feed(raw: DataFrame, payload: str, schema: T.StructType = PUSH_ITEM) -> DataFrame:
    return raw.withColumn("item", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))


def validate_feed(parsed: DataFrame, required: Iterable[str] = ("id_usuario", "vector_features", "dimension"),
                  item: str = "item") -> DataFrame:
    """Adds ``valid``: every required field is present. Rejects stay in the frame for a dead-letter write."""
    valid = F.col(item).isNotNull()
    for name in required:
        valid = valid & F.col(f"{item}.{name}").isNotNull()
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def feed_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if("valid").alias("processed"), F.count("*").alias("total"))


def require_nonblank(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    return df


def pending_outbox(outbox: DataFrame, flag: str = "sincronizado", created: str = "fecha_creacion",
                   key: str = "id_sync") -> DataFrame:
    """Unsent rows, oldest first."""
    return outbox.filter(F.col(flag) == 0).orderBy(created, key)


def rows_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One typed JSON object per row; the array form is a file of such lines."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def user_credentials(users: DataFrame, credentials: DataFrame, key: str = "id_usuario") -> DataFrame:
    return users.join(credentials, key)


def already_registered(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(existing.select(*keys).distinct(), keys, "left_semi")


def attach_phrase(attempts: DataFrame, phrases: DataFrame, key: str = "id_texto") -> DataFrame:
    return attempts.join(phrases, key)


def orphan_audit(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Children whose parent row is gone."""
    known = parents.select(F.col(parent_key or key).alias(key)).distinct()
    return children.join(known, key, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children left after their parents were deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def null_deleted(audit: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Audit rows kept, with the reference to a deleted parent set to null."""
    gone = deleted.select(key).distinct().withColumn("__gone", F.lit(True))
    joined = audit.join(gone, key, "left")
    cleared = F.when(F.col("__gone").isNull(), F.col(key)).alias(key)
    return joined.select(*[cleared if c == key else F.col(c) for c in audit.columns])


def insert_unique(existing: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table after insert, conflicting new rows). Repeats inside the new rows keep the first by all columns."""
    order = [c for c in new.columns if c not in keys] or keys
    first = new.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    fresh = first.filter("__r = 1").drop("__r").join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns)), already_registered(new, existing, keys)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows replaced by key; the new row wins, the latest by ``version`` among several.

    The winner is a partial aggregate, so many versions of one key do not meet in one sort.
    """
    tagged = existing.withColumn("__new", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("__new", F.lit(1)))
    row = F.struct(*existing.columns)
    best = F.max_by(row, F.struct("__new", version))
    return tagged.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(best.alias("r")).select("r.*")


def set_state(df: DataFrame, keys: DataFrame, key: str, state: str, now: Column, state_column: str = "estado",
              updated: str = "updated_at", allowed: Iterable[str] | None = None) -> DataFrame:
    """Moves listed rows to a state and stamps them; rows already there are untouched."""
    if allowed is not None and state not in allowed:
        raise ValueError(f"state must be one of {tuple(allowed)}")
    hit = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    change = F.col("__hit").isNotNull() & ~F.col(state_column).eqNullSafe(F.lit(state))
    joined = df.join(hit, key, "left")
    new_values = {
        state_column: F.when(change, F.lit(state)).otherwise(F.col(state_column)).alias(state_column),
        updated: F.when(change, now).otherwise(F.col(updated)).alias(updated),
    }
    return joined.select(*[new_values.get(c, F.col(c)) for c in df.columns])


def consume_phrase(phrases: DataFrame, events: DataFrame, key: str = "id_texto", uses: str = "contador_usos",
                   limit: str = "limite_usos", state: str = "estado_texto") -> DataFrame:
    """Adds the uses of a batch; a phrase that reaches its limit is switched off."""
    counted = events.groupBy(key).agg(F.count("*").alias("__used"))
    joined = phrases.join(counted, key, "left")
    total = F.coalesce(F.col(uses), F.lit(0)) + F.coalesce(F.col("__used"), F.lit(0))
    off = F.col("__used").isNotNull() & (total >= F.coalesce(F.col(limit), F.lit(USE_LIMIT)))
    new_values = {
        uses: total.alias(uses), state: F.when(off, F.lit(INACTIVE)).otherwise(F.col(state)).alias(state),
    }
    return joined.select(*[new_values.get(c, F.col(c)) for c in phrases.columns])


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def drop_class(model: DataFrame, classes: Iterable[int]) -> DataFrame:
    return model.filter(~F.col("class").isin(list(classes)))


def model_metadata(model: DataFrame) -> DataFrame:
    """(num_classes, dimension) recomputed from the rows."""
    return model.agg(F.count("*").alias("num_classes"), F.max(F.size("w")).alias("dimension"))


def enqueue_change(rows: DataFrame, table: str, action: str, created: Column, key: str) -> DataFrame:
    """Outbox rows for changed records."""
    return rows.select(
        F.col(key).cast("long").alias("id_sync"), F.lit(table).alias("tabla"), F.lit(action).alias("accion"),
        F.to_json(F.struct(*rows.columns)).alias("datos_json"), created.alias("fecha_creacion"),
        F.lit(0).alias("sincronizado"),
    )


def ack_changes(outbox: DataFrame, confirmed: DataFrame, key: str = "id_sync") -> DataFrame:
    """Marks rows sent, only for ids a confirmed write returned."""
    ok = confirmed.select(key).distinct().withColumn("__ok", F.lit(True))
    flag = F.when(F.col("__ok").isNotNull(), 1).otherwise(F.col("sincronizado")).cast("int").alias("sincronizado")
    return outbox.join(ok, key, "left").select(*[flag if c == "sincronizado" else F.col(c) for c in outbox.columns])


AUDIT_COLUMNS = (
    "id_usuario", "id_credencial", "tipo_biometria", "resultado", "confianza", "ip_cliente", "ubicacion",
    "dispositivo", "timestamp",
)


def audit_rows(decisions: DataFrame) -> DataFrame:
    """Decisions in the audit layout; columns a decision lacks are null."""
    return project_with_defaults(decisions, {c: None for c in AUDIT_COLUMNS})


def append_audit(audit: DataFrame, decisions: DataFrame) -> DataFrame:
    return audit.unionByName(audit_rows(decisions), allowMissingColumns=True)


def reset_tables(tables: Mapping[str, DataFrame], confirm: bool = False) -> dict[str, DataFrame]:
    """The listed tables emptied; needs an explicit flag."""
    if not confirm:
        raise ValueError("reset_tables needs confirm=True")
    return {n: (t.filter(F.lit(False)) if n in RESET_TABLES + RESET_CASCADE else t) for n, t in tables.items()}


def system_stats(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(stat, value) rows from named one-column aggregates."""
    rows = [df.select(F.lit(n).alias("stat"), F.col(df.columns[0]).cast("long").alias("value")) for n, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def scores_json(scores: DataFrame, by: str = "probe_id") -> DataFrame:
    """Class -> score map of each probe as JSON, in class order; one entry per enrolled class."""
    entry = F.struct(F.col("class").cast("string").alias("k"), F.col("score").alias("s"))
    packed = scores.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("class").alias("o"), entry.alias("e")))).alias("p"))
    return packed.select(by, F.to_json(F.map_from_entries(F.transform("p", lambda x: x["e"]))).alias("scores"))
