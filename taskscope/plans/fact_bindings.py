"""Code-fact tables derived from the driver tables.

Lines of orders act as calls, orders as decorators, parts as members, and events
as object literals and strings, so every check runs over whole tables. Lists are
comma-separated text here, because both engines read it; ``facts`` splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables

_P = "'C' || CAST({k} % 40 AS VARCHAR(20)) AS class"

CALLS = """
SELECT k % 11 AS repo, 'f' || CAST(k % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(k / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(n * 10 + o % 7 AS INT) AS line, CAST(o AS INT) AS col, CAST(o AS VARCHAR(20)) || '-' || CAST(k % 2 AS VARCHAR(20)) AS fn_id,
  'C' || CAST(k % 40 AS VARCHAR(20)) AS class, 'm' || CAST(n % 4 AS VARCHAR(20)) AS member, k % 3 = 0 AS root_this,
  CASE WHEN k % 3 = 0 AND k % 5 > 0 THEN CASE k % 4 WHEN 0 THEN 'products' WHEN 1 THEN 'userRepo' ELSE 'db' END WHEN k % 3 = 1 THEN CASE WHEN q % 2 = 0 THEN 'items.slice(0, 3)' ELSE 'items' END END AS field,
  CASE q % 5 WHEN 0 THEN 'prisma.user.x' WHEN 1 THEN 'new Pool' ELSE 'a.b' END AS callee_path,
  CASE WHEN k % 3 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE CASE q % 8 WHEN 0 THEN 'orderRepo' WHEN 1 THEN 'axios' WHEN 2 THEN 'Promise' WHEN 3 THEN 'fs' WHEN 4 THEN 'ThrottlerModule'
     WHEN 5 THEN 'x.createQueryBuilder("u")' WHEN 6 THEN 'x.createQueryBuilder("u").limit(5)' ELSE CAST(NULL AS VARCHAR(20)) END END AS base_text,
  CASE (k * 7 + n) % 24 WHEN 0 THEN 'find' WHEN 1 THEN 'findOne' WHEN 2 THEN 'save' WHEN 3 THEN 'update' WHEN 4 THEN 'findMany' WHEN 5 THEN 'create' WHEN 6 THEN '$queryRawUnsafe' WHEN 7 THEN 'exec'
    WHEN 8 THEN 'spawn' WHEN 9 THEN 'readFileSync' WHEN 10 THEN 'writeFile' WHEN 11 THEN 'getMany' WHEN 12 THEN 'query' WHEN 13 THEN 'where' WHEN 14 THEN 'Pool' WHEN 15 THEN 'fetch' WHEN 16 THEN 'get'
    WHEN 17 THEN 'all' WHEN 18 THEN 'forRoot' WHEN 19 THEN 'session' WHEN 20 THEN 'hashSync' WHEN 21 THEN 'upsert' WHEN 22 THEN 'findBy' ELSE 'count' END AS method,
  CASE q % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'ident' WHEN 2 THEN 'template' WHEN 3 THEN 'concat' WHEN 4 THEN 'map' ELSE 'function' END AS arg0_kind,
  CASE q % 7 WHEN 0 THEN '"SELECT " + body0' WHEN 1 THEN 'join(uploads, body1)' WHEN 2 THEN 'ORDER BY $' || '{K' || CAST(k % 5 AS VARCHAR(20)) || '.x}' WHEN 3 THEN '$' || '{fn(1)} LIMIT $' || '{K1}' WHEN 4 THEN 'items.map(async i => await f(i))' WHEN 5 THEN '/tmp/report' ELSE 'body2' END AS arg0_text,
  CASE q % 5 WHEN 0 THEN 'take' WHEN 1 THEN 'max,idleTimeoutMillis' WHEN 2 THEN 'max' WHEN 3 THEN 'select,store' ELSE '' END AS opts,
  CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END AS loop_depth, q % 4 = 0 AS shell_true, CAST(q % 3 AS INT) AS include_depth
FROM (SELECT l_partkey AS k, l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}) x
"""
DECORATORS = """
SELECT c % 11 AS repo, 'f' || CAST(c % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(c / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(o % 500 AS INT) AS line, 'C' || CAST(c % 40 AS VARCHAR(20)) AS class,
  CASE o % 5 WHEN 0 THEN 'class' WHEN 3 THEN 'property' WHEN 4 THEN 'param' ELSE 'method' END AS owner_kind,
  CASE WHEN o % 5 = 0 THEN CAST(NULL AS VARCHAR(20)) WHEN o % 5 = 3 THEN CASE o % 6 WHEN 0 THEN 'password' WHEN 1 THEN 'email' WHEN 2 THEN 'slug' WHEN 3 THEN 'ownerId' WHEN 4 THEN 'price' ELSE 'token' END
    WHEN o % 11 = 0 THEN 'login' ELSE 'm' || CAST(o % 4 AS VARCHAR(20)) END AS member,
  CASE WHEN o % 5 = 4 THEN 'body' || CAST(o % 3 AS VARCHAR(20)) END AS param,
  CASE o % 5 WHEN 0 THEN CASE o % 4 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Entity' WHEN 2 THEN CASE WHEN o % 3 = 0 THEN 'UseGuards' WHEN o % 3 = 1 THEN 'Index' ELSE 'Injectable' END ELSE CASE WHEN o % 7 = 0 THEN 'SerializeOptions' ELSE 'Injectable' END END
    WHEN 3 THEN CASE o % 8 WHEN 0 THEN 'ManyToOne' WHEN 1 THEN 'Column' WHEN 2 THEN 'Exclude' WHEN 3 THEN 'Index' WHEN 4 THEN 'OneToMany' WHEN 5 THEN 'Column' WHEN 6 THEN 'IsString' ELSE 'Unique' END
    WHEN 4 THEN CASE o % 3 WHEN 0 THEN 'Body' WHEN 1 THEN 'Query' ELSE 'Other' END
    ELSE CASE o % 10 WHEN 0 THEN 'UseGuards' WHEN 1 THEN 'Get' WHEN 2 THEN 'Post' WHEN 3 THEN 'Cron' WHEN 4 THEN 'Throttle' WHEN 5 THEN 'UseInterceptors' WHEN 6 THEN 'Put' WHEN 7 THEN 'Public' ELSE 'Delete' END END AS name,
  CASE o % 7 WHEN 0 THEN '"slug", "ownerId"' WHEN 1 THEN 'ThrottlerGuard' WHEN 2 THEN 'ClassSerializerInterceptor' ELSE '' END AS arg_text,
  CASE o % 6 WHEN 0 THEN 'users' WHEN 1 THEN 'health' WHEN 2 THEN 'auth/token' ELSE CAST(NULL AS VARCHAR(20)) END AS first_string,
  CASE o % 9 WHEN 0 THEN 'eager' WHEN 1 THEN 'unique' WHEN 2 THEN 'eager,unique' ELSE '' END AS trues
FROM (SELECT o_custkey AS c, o_orderkey AS o FROM {orders}) x
"""
MEMBERS = """
SELECT k % 11 AS repo, 'f' || CAST(k % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(k / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(k % 300 AS INT) AS line, CASE WHEN k % 7 = 6 THEN CAST(NULL AS VARCHAR(20)) ELSE 'C' || CAST(k % 40 AS VARCHAR(20)) END AS class,
  CASE k % 7 WHEN 0 THEN CASE k % 4 WHEN 0 THEN 'products' WHEN 1 THEN 'db' ELSE 'svc' END WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'email' ELSE 'apiKey' END WHEN 2 THEN 'm' || CAST(k % 4 AS VARCHAR(20))
     WHEN 6 THEN CASE k % 3 WHEN 0 THEN 'sessionCache' ELSE 'plain' END WHEN 5 THEN 'locks' ELSE 'name' END AS member,
  CASE k % 7 WHEN 0 THEN 'ctor_param' WHEN 2 THEN 'method' WHEN 6 THEN 'variable' ELSE 'property' END AS kind,
  CASE WHEN k % 7 = 0 THEN CASE k % 4 WHEN 0 THEN 'Repository' WHEN 1 THEN 'PrismaService' ELSE 'C' || CAST(s % 40 AS VARCHAR(20)) END END AS type_name,
  CASE WHEN k % 7 = 0 THEN 'C' || CAST((k + 1) % 40 AS VARCHAR(20)) END AS type_arg, CASE WHEN k % 5 = 0 THEN 'Promise<UserDto>' ELSE '' END AS return_type_text,
  CASE s % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'array' WHEN 2 THEN 'empty_object' ELSE 'call' END AS init_kind, CASE WHEN s % 3 = 0 THEN 'Map' ELSE 'Date' END AS init_ctor
FROM (SELECT p_partkey AS k, p_size AS s FROM {part}) x
"""
PARAMS = """
SELECT c % 11 AS repo, 'f' || CAST(c % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(c / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(o % 500 AS INT) AS line, 'C' || CAST(c % 40 AS VARCHAR(20)) AS class, CASE WHEN o % 11 = 0 THEN 'login' ELSE 'm' || CAST(o % 4 AS VARCHAR(20)) END AS member,
  'body' || CAST(o % 3 AS VARCHAR(20)) AS param, CASE WHEN o % 2 = 0 THEN 'C' || CAST(o % 40 AS VARCHAR(20)) END AS type_name, o % 16 = 0 AS is_any FROM (SELECT o_custkey AS c, o_orderkey AS o FROM {orders}) x WHERE o % 5 = 4
"""
RETURNS = """
SELECT k % 11 AS repo, 'f' || CAST(k % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(k / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(n * 10 + o % 7 AS INT) AS line, 'C' || CAST(k % 40 AS VARCHAR(20)) AS class, 'm' || CAST(n % 4 AS VARCHAR(20)) AS member,
  CASE WHEN o % 2 = 0 THEN 'products' ELSE 'svc' END AS via_field, CASE o % 5 WHEN 0 THEN 'findOne' WHEN 1 THEN 'save' WHEN 2 THEN 'm1' WHEN 3 THEN 'm2' ELSE 'm3' END AS via_method
FROM (SELECT l_partkey AS k, l_orderkey AS o, l_linenumber AS n FROM {lineitem}) x
"""
FUNCTIONS = """
SELECT DISTINCT k % 11 AS repo, CAST(o AS VARCHAR(20)) || '-' || CAST(k % 2 AS VARCHAR(20)) AS fn_id,
  CASE o % 5 WHEN 0 THEN 'await ds.transaction(x)' WHEN 1 THEN 'prisma.$transaction(y)' WHEN 2 THEN 'path.relative(a, b)' ELSE 'plain' END AS body_text
FROM (SELECT l_partkey AS k, l_orderkey AS o FROM {lineitem}) x
"""
CLASSES = """
SELECT DISTINCT k % 11 AS repo, 'C' || CAST(k % 40 AS VARCHAR(20)) AS class, CASE k % 9 WHEN 0 THEN 'Repository' WHEN 1 THEN 'PrismaClient' ELSE CAST(NULL AS VARCHAR(20)) END AS base_class FROM (SELECT p_partkey AS k FROM {part}) x
"""
CATCH_PROPS = """
SELECT user_id % 11 AS repo, 'f' || CAST(user_id % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(user_id / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(event_id % 400 AS INT) AS line, 'e' AS catch_var,
  CASE event_id % 3 WHEN 0 THEN 'stack' WHEN 1 THEN 'message' ELSE 'code' END AS prop, CASE event_id % 4 WHEN 0 THEN 'e.stack' WHEN 1 THEN 'e.message' ELSE 'e.code' END AS value_text FROM {events}
"""
OBJECT_PROPS = """
SELECT user_id % 11 AS repo, 'f' || CAST(user_id % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(user_id / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(event_id % 400 AS INT) AS line, CAST(floor(event_id / 3) AS BIGINT) % 1000 AS object_id,
  CASE event_id % 3 WHEN 0 THEN 'origin' WHEN 1 THEN 'credentials' ELSE 'synchronize' END AS prop,
  CASE event_id % 3 WHEN 0 THEN CASE event_id % 4 WHEN 0 THEN '"*"' WHEN 1 THEN 'true' ELSE '"https"' END ELSE CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END END AS value_text FROM {events}
"""
CONSTANTS = """
SELECT DISTINCT k % 11 AS repo, 'f' || CAST(k % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(k / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, 'K' || CAST(k % 3 AS VARCHAR(20)) AS name FROM (SELECT p_partkey AS k FROM {part}) x
"""
STRINGS = """
SELECT user_id % 11 AS repo, 'f' || CAST(user_id % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(user_id / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(event_id % 70 AS INT) AS line,
  CASE event_id % 3 WHEN 0 THEN 'SELECT a FROM t WHERE id = ' || CAST(event_id AS VARCHAR(20)) WHEN 1 THEN 'delete from t where x' ELSE 'selection' END AS value,
  CASE event_id % 4 WHEN 0 THEN 'concat' WHEN 1 THEN 'template' WHEN 2 THEN 'tagged' ELSE 'literal' END AS build FROM {events}
"""
LOOPS = """
SELECT k % 11 AS repo, 'f' || CAST(k % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(k / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CAST(o AS VARCHAR(20)) AS fn_id, CAST(n * 10 AS INT) AS start_line, CAST(n * 10 + q % 4 AS INT) AS end_line,
  CASE q % 4 WHEN 0 THEN 'for' WHEN 1 THEN 'for-of' WHEN 2 THEN 'while' ELSE 'for' END AS kind, CAST(q % 2 AS INT) AS await_count, CASE WHEN q % 5 = 0 THEN 'await repo.save(x)' ELSE 'await read(x)' END AS body_text
FROM (SELECT l_partkey AS k, l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}) x
"""
FILE_TEXTS = """
SELECT DISTINCT k % 11 AS repo, 'f' || CAST(k % 11 AS VARCHAR(20)) || CASE WHEN CAST(floor(k / 440) AS BIGINT) % 2 = 1 THEN 'b' ELSE '' END || '.ts' AS file, CASE k % 11 % 5 WHEN 0 THEN 'throttler setup' WHEN 1 THEN 'throttle with redis' WHEN 2 THEN 'uses redlock' ELSE 'plain' END AS text FROM (SELECT p_partkey AS k FROM {part}) x
"""

BINDINGS = {
    "calls": CALLS, "decorators": DECORATORS, "members": MEMBERS, "params": PARAMS, "returns": RETURNS, "functions": FUNCTIONS, "classes": CLASSES,
    "catch_props": CATCH_PROPS, "object_props": OBJECT_PROPS, "constants": CONSTANTS, "strings": STRINGS, "loops": LOOPS, "sources": FILE_TEXTS,
}


def facts(t: Tables) -> dict[str, DataFrame]:
    """Fact tables by name, with their list columns as arrays."""
    split = lambda c: F.filter(F.split(c, ","), lambda v: v != "")
    out = {name: t.derive(sql) for name, sql in BINDINGS.items()}
    out["calls"] = out["calls"].withColumn("option_keys", split("opts")).drop("opts")
    out["decorators"] = out["decorators"].withColumn("true_keys", split("trues")).drop("trues")
    return out
