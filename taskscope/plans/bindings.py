"""Operator inputs derived from the driver tables.

The driver tables hold no repositories, rules or tool events, so every input is
derived from them by plain SQL that both engines understand. Each binding reads
whole tables and grows with them.
"""

from __future__ import annotations

NL = "chr(10)"

# user turns as tasks; some of them with words the alias and intent tables know
TASKS = """
SELECT 'all' AS repo, conv_id * 100 + turn AS task_id,
       text || CASE conv_id % 6 WHEN 0 THEN ' please review the upload flow'
                                WHEN 1 THEN ' recheck authen in src/user.service.ts'
                                WHEN 2 THEN ' implement kiem duyet for tai len'
                                WHEN 3 THEN ' add notifications and payment'
                                ELSE '' END AS prompt,
       conv_id, turn
FROM {conversations} WHERE role = 'user'
"""

# benchmark passages as written rules
RULES = """
SELECT 'all' AS repo, 'p' || CAST(item_id AS VARCHAR(20)) AS rule_id, item_id AS pos,
       text || CASE item_id % 5 WHEN 0 THEN ' Always verify the login.'
                                WHEN 1 THEN ' moderation and approval pipeline for resource'
                                WHEN 2 THEN ' Never notify twice.'
                                WHEN 3 THEN ' see user.service.ts'
                                ELSE '' END AS content
FROM {benchmark}
"""

# documents as rule files: bullets, source switches, rules and blank lines
RULE_DOCS = """
SELECT doc_id, source,
       CASE WHEN doc_id % 3 = 0 THEN '## Source: ' || source || chr(10) ELSE '' END
       || replace(replace(replace(text, '. ', '.' || chr(10) || '- '), ', ', chr(10)), ' and ', chr(10) || '---' || chr(10)) AS text
FROM {documents}
"""

# one migration file per order, one report query per hundredth order
SQL_FILES = """
SELECT o_orderkey AS repo,
       CASE WHEN o_orderkey % 10 = 9 THEN 'sql/report_' ELSE 'db/migrations/' END || CAST(o_orderkey AS VARCHAR(20)) || '.sql' AS path,
       '-- order ' || CAST(o_orderkey AS VARCHAR(20)) || chr(10) || chr(10) ||
       CASE o_orderkey % 9
         WHEN 0 THEN 'ALTER TABLE t' || CAST(o_custkey AS VARCHAR(20)) || chr(10) || '  ADD COLUMN c varchar(8) NOT NULL;'
         WHEN 1 THEN 'ALTER TABLE t ADD COLUMN c varchar NOT NULL DEFAULT 1; -- ok'
         WHEN 2 THEN 'ALTER TABLE t ALTER COLUMN total TYPE numeric;'
         WHEN 3 THEN 'ALTER TABLE t ADD CONSTRAINT fk FOREIGN KEY (a)' || chr(10) || ' REFERENCES u(a);'
         WHEN 4 THEN 'ALTER TABLE t ADD CONSTRAINT fk FOREIGN KEY (a) REFERENCES u(a) NOT VALID;'
         WHEN 5 THEN 'CREATE UNIQUE INDEX i' || chr(10) || ' ON t (a);'
         WHEN 6 THEN 'CREATE INDEX CONCURRENTLY i ON t (a);' || chr(10) || 'UPDATE t SET a = 1;'
         WHEN 7 THEN 'DELETE FROM t' || chr(10) || 'WHERE id = ' || CAST(o_custkey AS VARCHAR(20)) || ';'
         ELSE 'INSERT INTO t VALUES (1); DELETE FROM t;' END
       || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN 'SELECT * FROM orders;' WHEN o_orderkey % 4 = 1 THEN 'SELECT * FROM orders LIMIT 5' ELSE '' END AS text
FROM {orders}
"""

# one schema file per part
SCHEMA_FILES = """
SELECT p_partkey AS repo, 'prisma/schema.prisma' AS file,
  'datasource db {' || chr(10) || '  provider = "postgresql"' || chr(10) || '  url = ' ||
  CASE WHEN p_size % 2 = 0 THEN 'env("DATABASE_URL")' ELSE '"postgres://app:pw@db:5432/x' || CAST(p_partkey AS VARCHAR(20)) || '"' END || chr(10) || '}' || chr(10) || chr(10)
  || 'model Item {' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '  id Int @id' || chr(10) END
  || '  email String' || CASE WHEN p_partkey % 4 = 0 THEN ' @unique' ELSE '' END || chr(10) || '  slug String?' || chr(10)
  || '  ownerId Int' || chr(10) || '  owner Owner @relation(fields: [ownerId], references: [id])' || chr(10)
  || '  price Float // money' || chr(10) || '  tags String[]' || chr(10)
  || CASE WHEN p_partkey % 5 = 0 THEN '  @@index([ownerId])' || chr(10) ELSE '' END || '}' || chr(10)
  || 'enum Color {' || chr(10) || '  RED' || chr(10) || '}' || chr(10)
  || 'model Owner {' || chr(10) || '  id Int @id' || chr(10) || '  items Item[]' || chr(10) || '}' AS text
FROM {part}
"""

# documents carry token = "<hex>" lines; some names become secret-like
CREDENTIAL_TEXT = """replace(text, 'token = ', CASE WHEN doc_id % 2 = 0 THEN 'secret = ' ELSE 'token = ' END) || chr(10) ||
  CASE doc_id % 7 WHEN 0 THEN 'secretOrKey: "supersecret' || CAST(doc_id AS VARCHAR(20)) || '"'
                  WHEN 1 THEN 'secret: "super-secret-jwt-signing-key-' || CAST(doc_id AS VARCHAR(20)) || '"'
                  WHEN 2 THEN 'password: "DB_PASSWORD_' || CAST(doc_id AS VARCHAR(20)) || '"'
                  WHEN 3 THEN 'url = "postgres://app:s3cr3t@db' || CAST(doc_id AS VARCHAR(20)) || '.example.com/x"'
                  WHEN 4 THEN 'url = "postgres://app:s3cr3t@db:5432/x"'
                  WHEN 5 THEN 'apiKey: "config.jwt.secret"'
                  ELSE 'id = "AKIAABCDEFGHIJ' || CAST(100000 + doc_id AS VARCHAR(20)) || '"' END"""

# pages as source files of one repository per language path
SOURCE_TEXTS = """
SELECT split_part(url, '/', 3) AS repo,
       CASE WHEN page_id % 5 = 0 THEN 'src/main.ts' ELSE 'src/p' || CAST(page_id AS VARCHAR(20)) || '.ts' END AS file,
       html || CASE WHEN page_id % 11 = 0 THEN ' process.on("SIGTERM")' WHEN page_id % 7 = 0 THEN ' /healthz ' ELSE '' END AS text
FROM {pages}
"""
REPO_FILES = """
SELECT split_part(url, '/', 3) AS repo, CASE WHEN page_id % 3 = 0 THEN 'Dockerfile' ELSE 'package.json' END AS path FROM {pages}
"""
COUNTER_TEXTS = """
SELECT lang AS repo, 'd' || CAST(doc_id AS VARCHAR(20)) AS file,
  text || chr(10) || 'cd /home/' || CASE WHEN doc_id % 4 = 0 THEN 'runner' ELSE 'u' || CAST(doc_id % 9 AS VARCHAR(20)) END || '/work' || chr(10)
  || CASE doc_id % 5 WHEN 0 THEN 'spawn(x, { shell: true })' WHEN 1 THEN '// shell: true' WHEN 2 THEN 'log("shell: true")' ELSE 'id: "SEC-' || CAST(doc_id % 13 AS VARCHAR(20)) || '"' END || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN 'old_a old_b' WHEN 1 THEN 'old_a to new_a' ELSE '' END AS text
FROM {documents}
"""
CATALOG_DOCS = """
SELECT doc_id, source, 'x/pack' || CAST(doc_id AS VARCHAR(20)) || '/SKILL.md' AS path,
  '---' || chr(10) || 'name: "pack ' || lang || '"' || chr(10) || '---' || chr(10)
  || '# Title' || chr(10) || chr(10) || '## Triggers' || chr(10) || '- alpha' || chr(10) || '- `' || lang || ' build`' || chr(10)
  || '## Evidence' || chr(10) || '- pg' || chr(10) || '- src/' || lang || '.ts' || chr(10) || 'dep' || CAST(doc_id AS VARCHAR(20)) || chr(10)
  || '## Requires' || chr(10) || '- ' || source || chr(10) || '## Notes' || chr(10) || text AS body,
  CASE WHEN doc_id % 2 = 0 THEN 'Use for vercel deploys' ELSE 'Realtime chat of rooms' END AS summary
FROM {documents}
"""
CATALOG_DOCS = f"SELECT doc_id, path, replace(body, '---' || chr(10) || '# Title', 'description: ' || summary || chr(10) || '---' || chr(10) || '# Title') AS text FROM ({CATALOG_DOCS}) c"
WORKFLOW_DOCS = """
SELECT doc_id, 'w/flow-' || CAST(doc_id AS VARCHAR(20)) || '.md' AS path,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE '# Plan ' || lang || chr(10) || chr(10) END
  || CASE WHEN doc_id % 2 = 0 THEN 'Ask the `tester-agent`, then a planner.' ELSE 'A planner and a code-reviewer work.' END || chr(10) || chr(10)
  || '### 1. First' || chr(10) || text AS text
FROM {documents}
"""
# links of a page as relative imports
PAGE_SOURCES = """
SELECT page_id, array_join(transform(filter(regexp_extract_all(html, 'href="(/[^"]*)"', 1), h -> NOT contains(h, chr(39))),
   h -> CASE WHEN length(h) % 2 = 0 THEN concat('import a from "./x', h, '";') ELSE concat('const b = require("..', h, '");') END), chr(10)) AS text
FROM {pages}
"""
MENTION_TASKS = """
SELECT 'all' AS repo, conv_id * 100 + turn AS task_id,
  'fix ' || CASE conv_id % 3
    WHEN 0 THEN 'src/modules/m' || CAST((conv_id * 7 + turn) % 50 AS VARCHAR(20)) || '/a.controller.ts:12:3, now ' || text
    WHEN 1 THEN 'lib/f' || CAST((conv_id * 7 + turn) % 50 AS VARCHAR(20)) || '.ts(3,4). and b.service.ts on GET /users/x ' || text
    ELSE 'src/modules/m' || CAST((conv_id * 7 + turn) % 50 AS VARCHAR(20)) || '; ' || text END AS prompt, conv_id, turn
FROM {conversations} WHERE role = 'user'
"""
# every word of the benchmark is a known id; SPLIT stands for an engine's way to make a row of each word
ANSWER_IDS = """
SELECT DISTINCT lower(w) AS id FROM (SELECT SPLIT AS w FROM {benchmark}) WHERE length(w) > 2
"""
RUN_LOGS = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no summary' ELSE
  chr(27) || '[32mTests ' || chr(27) || '[0m ' || CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR(20)) || ' failed | ' ELSE '' END || CAST(event_id AS VARCHAR(20)) || ' passed' END AS log
FROM {events}
"""
PAYLOADS = """
SELECT event_id, '{"cwd":"/w' || CAST(user_id AS VARCHAR(20)) || '","v":' || CAST(event_id AS VARCHAR(20)) || ',' ||
  CASE event_id % 4 WHEN 0 THEN '"toolName":"code-review-graph.query_graph"'
                    WHEN 1 THEN '"command":"rtk run ' || chr(92) || '"' || CAST(user_id AS VARCHAR(20)) || chr(92) || '""'
                    WHEN 2 THEN '"note":["use agentmemory here"]' ELSE '"tool":"bash"' END || '}' AS payload
FROM {events}
"""
RPC_LINES = """
SELECT event_id, CASE event_type WHEN 'click' THEN '{"method":"tools/call","params":{"name":"' || CASE WHEN user_id % 2 = 0 THEN event_type ELSE '' END || '"}}'
                                 WHEN 'view' THEN '{"method":"tools/call","params":{' || CASE WHEN user_id % 2 = 0 THEN '"name":"view"' ELSE '' END || '}}'
                                 WHEN 'error' THEN '{broken' ELSE '{"method":"ping"}' END AS line
FROM {events}
"""
LISTING_DOCS = """
SELECT page_id, array_join(transform(filter(regexp_extract_all(html, '<li><a href="([^"]*)">', 1), u -> NOT regexp_like(u, '[()\\\\[\\\\]]')),
   u -> concat('- **[n ', u, '](', u, ')** - about ', u)), chr(10)) || chr(10) || '- [img](a.png) - x' || chr(10) || '- [top](#top)' AS text
FROM {pages}
"""

# tasks with open files
OPEN_TASKS = f"""
SELECT repo, task_id, prompt, CASE WHEN conv_id % 4 = 1 THEN array('src/user.service.ts', 'lib/x.ts') ELSE array() END AS open_files FROM ({TASKS}) t
"""

# parts as files of one repository per brand, and tasks that name some of them
FILES = """
SELECT DISTINCT p_brand AS repo,
  CASE WHEN p_partkey % 40 = 0 THEN 'prisma/schema.prisma' WHEN p_partkey % 41 = 0 THEN 'packages/w' || CAST(p_partkey % 9 AS VARCHAR(20)) || '/prisma/schema.prisma'
  WHEN p_partkey % 43 = 0 THEN 'package.json' ELSE
  CASE p_partkey % 8 WHEN 0 THEN 'lib/f' || CAST(p_partkey % 50 AS VARCHAR(20)) || '.ts'
    WHEN 1 THEN 'src/modules/m' || CAST(p_partkey % 50 AS VARCHAR(20)) || '/a.controller.ts'
    WHEN 2 THEN 'src/modules/m' || CAST(p_partkey % 50 AS VARCHAR(20)) || '/b.service.ts'
    WHEN 3 THEN 'src/modules/m' || CAST(p_partkey % 50 AS VARCHAR(20)) || '/c.module.ts'
    WHEN 4 THEN 'src/modules/m' || CAST(p_partkey % 50 AS VARCHAR(20)) || '/dto/d.ts'
    WHEN 5 THEN 'src/modules/m' || CAST(p_partkey % 50 AS VARCHAR(20)) || '/index.ts'
    WHEN 6 THEN 'packages/w' || CAST(p_partkey % 9 AS VARCHAR(20)) || '/package.json'
    ELSE 'packages/w' || CAST(p_partkey % 9 AS VARCHAR(20)) || '/lib/f' || CAST(p_partkey % 50 AS VARCHAR(20)) || '.ts' END END AS path
FROM {part}
"""
PACKAGES = f"SELECT DISTINCT repo, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir FROM ({FILES}) f WHERE path LIKE 'packages/%/package.json'"
FILE_TASKS = f"""
SELECT 'Brand#' || CAST(1 + conv_id % 25 AS VARCHAR(20)) AS repo, task_id,
       prompt || CASE turn % 3 WHEN 0 THEN ' build the app in w' || CAST(conv_id % 9 AS VARCHAR(20)) ELSE ' change the status enum' END AS prompt
FROM ({MENTION_TASKS}) t
"""
# candidates of three sources for every task
CANDIDATES = """
SELECT conv_id AS task_id, 'f' || CAST((turn * 7 + conv_id) % 13 AS VARCHAR(20)) || '.ts' AS path,
       CAST((conv_id + turn * 3) % 17 AS DOUBLE) AS score, role AS source, turn AS pos FROM {conversations}
"""
# parts as catalog items of a brand
SCORED_PARTS = """
SELECT p_brand AS task_id, 'part ' || CAST(p_partkey AS VARCHAR(20)) AS name, p_type AS bucket, round(CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000, 3) AS score,
       p_partkey AS pos, p_size FROM {part}
"""
# order pairs of parts as relations
PART_EDGES = """
SELECT DISTINCT 'all' AS repo, a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey
"""
# page links as source files and imports of one repository
LINK_FILES = """
SELECT DISTINCT split_part(url, '/', 3) AS repo, 'src/' || split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1) ||
   CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.tsx' END AS path FROM {pages}
"""
LINK_IMPORTS = """
SELECT split_part(url, '/', 3) AS repo, 'src/lib/p' || CAST(page_id AS VARCHAR(20)) || '.ts' AS path,
  CASE page_id % 4 WHEN 0 THEN '../' || CAST(page_id AS VARCHAR(20)) WHEN 1 THEN './../' || split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1)
    WHEN 2 THEN '../' || split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1) || '.ts' ELSE '../../../x' END AS specifier FROM {pages}
"""
# suppliers as catalog items, nations as repositories with evidence
CATALOG = """
SELECT 'item ' || CAST(s_suppkey AS VARCHAR(20)) AS id, 'item ' || CAST(s_suppkey AS VARCHAR(20)) AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'azure upload tool' WHEN 1 THEN 'review notifications flow' WHEN 2 THEN 'python login' WHEN 3 THEN 'moderation of uploads' ELSE 'plain text' END AS description,
  CASE WHEN s_suppkey % 3 = 0 THEN 'project' ELSE 'global' END AS scope,
  CASE WHEN s_suppkey % 4 = 0 THEN '/h/.config/skillshare/skills/x' ELSE '/h/.codex/skills/x' END AS path,
  CASE s_suppkey % 6 WHEN 0 THEN 'upload flow' WHEN 1 THEN 'ui' WHEN 2 THEN 'notifications' WHEN 3 THEN 'kiem duyet' WHEN 4 THEN 'review' ELSE 'nothing like it' END AS trig,
  CASE s_suppkey % 4 WHEN 0 THEN 'payment' ELSE 'zzz' END AS neg,
  'dep' || CAST(s_suppkey % 30 AS VARCHAR(20)) AS dep,
  CASE s_suppkey % 3 WHEN 0 THEN 'docker/*' WHEN 1 THEN 'cfg' || CAST(s_suppkey % 7 AS VARCHAR(20)) || '.json' ELSE 'none.txt' END AS fil,
  s_suppkey AS ord
FROM {supplier}
"""
CATALOG_META = f"""
SELECT id, name, description, scope, path, ord, named_struct('intent', array(), 'positive_prompts', array(trig), 'files', array(fil), 'dependencies', array(dep),
  'negative_prompts', array(neg), 'negative_files', array(), 'negative_dependencies', array(), 'workflows', array(), 'related_skills', array(),
  'depends_on', array(), 'provides', array(), 'requires', array(), 'suggested_files', array()) AS meta FROM ({CATALOG}) c
"""
EVIDENCE = """
SELECT DISTINCT 'Brand#' || CAST(1 + c_custkey % 25 AS VARCHAR(20)) AS repo, CASE c_custkey % 3 WHEN 0 THEN 'dependency' ELSE 'file' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN 'Dep' || CAST(c_custkey % 31 AS VARCHAR(20)) WHEN 1 THEN 'docker/c' || CAST(c_custkey % 5 AS VARCHAR(20)) ELSE 'a/CFG' || CAST(c_custkey % 11 AS VARCHAR(20)) || '.json' END AS value
FROM {customer}
"""
CATALOG_TASKS = f"SELECT 'Brand#' || CAST(1 + conv_id % 25 AS VARCHAR(20)) AS repo, task_id, prompt || CASE WHEN turn % 4 = 0 THEN ' $item-7' ELSE '' END AS prompt FROM ({TASKS}) t"
