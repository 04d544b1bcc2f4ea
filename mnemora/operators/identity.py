"""Users and API keys as tables: lookups, issue, revoke, authentication of a batch of tokens.

Users: (user_id, handle, email). Keys: (prefix, user_id, secret_hash, scopes, created_at, revoked_at, last_used_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def directory(users: DataFrame) -> DataFrame:
    """All users by handle."""
    return users.orderBy("handle")


def by_handle(users: DataFrame, handle: str) -> DataFrame:
    """The user of a handle, however it is written, or nothing."""
    return users.filter(F.col("handle") == handle.strip().lower())


def new_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """(handle, email, reject_reason) of wanted users: bad handle or address, or a handle that is taken."""
    named = rows.select(T.ascii_lower(T.tidy(F.col("handle"))).alias("handle"), "email")
    taken = named.join(users.select("handle", F.lit(True).alias("_taken")), "handle", "left")
    reason = F.when(~F.coalesce(T.valid_handle(F.col("handle")), F.lit(False)), "bad handle").when(F.col("email").isNotNull() & ~T.valid_email(F.col("email")), "bad e-mail address").when(F.col("_taken"), "handle is taken")
    return taken.select("handle", "email", reason.alias("reject_reason"))


def keys_of(keys: DataFrame, user_id: int) -> DataFrame:
    """A user's keys, oldest first, without their hashes."""
    return keys.filter(F.col("user_id") == user_id).drop("secret_hash").orderBy("created_at", "prefix")


def issue(tokens: DataFrame, scheme: str, now: Column) -> DataFrame:
    """Key rows of (user_id, token, scopes): the token's secret is kept as a hash only; malformed tokens are dropped."""
    parts = T.api_key_parts(F.col("token"), scheme)
    kept = tokens.withColumn("_p", parts).filter("_p IS NOT NULL")
    return kept.select(F.col("_p.prefix").alias("prefix"), "user_id", F.sha2("token", 256).alias("secret_hash"), T.scopes(F.col("scopes")).alias("scopes"), now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"), F.lit(None).cast("timestamp_ntz").alias("last_used_at"))


def revoke(keys: DataFrame, prefixes: list[str], now: Column) -> DataFrame:
    """Keys with those of ``prefixes`` revoked; a second time changes nothing."""
    hit = F.col("prefix").isin(*prefixes)
    return keys.withColumn("revoked_at", F.when(hit, F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at")))


def authenticate(requests: DataFrame, keys: DataFrame, users: DataFrame, scheme: str, scope: str) -> DataFrame:
    """(request_id, user_id, handle, status) of (request_id, token): 200, 401 for any key that does not hold, 403 without the scope."""
    asked = requests.select("request_id", T.api_key_parts(F.col("token"), scheme)["prefix"].alias("prefix"), F.sha2("token", 256).alias("_h"))
    held = keys.filter("revoked_at IS NULL").select("prefix", "user_id", "secret_hash", "scopes").join(users.select("user_id", "handle"), "user_id")
    joined = asked.join(held, (asked["prefix"] == held["prefix"]) & (F.col("_h") == F.col("secret_hash")), "left")
    status = F.when(F.col("user_id").isNull(), 401).when(T.allows(F.col("scopes"), scope), 200).otherwise(403)
    return joined.select("request_id", F.when(status == 200, F.col("user_id")).alias("user_id"), F.when(status == 200, F.col("handle")).alias("handle"), status.alias("status"))


def touched(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """Keys with ``last_used_at`` from a log of (prefix, at)."""
    last = uses.groupBy("prefix").agg(F.max("at").alias("_at"))
    return keys.join(last, "prefix", "left").withColumn("last_used_at", F.greatest("last_used_at", "_at")).drop("_at")
