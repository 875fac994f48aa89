"""SQL for the rule cascades, written by itself: rules as rows with a rank, the least rank that matches decides.

Nothing here comes from the tables or the expressions that the queries are made of, so that a slip in those shows.
"""

from __future__ import annotations


def _rows(text: str) -> str:
    """VALUES of the lines of a table; the first column is the rank, the cells after it are parted by semicolons."""
    out = []
    for k, line in enumerate(x for x in text.strip().splitlines() if x.strip()):
        cells = [c.strip() for c in (line.strip() + " ").split(" ; ")]
        out.append(f"({k}, " + ", ".join("'" + c.replace("'", "''") + "'" for c in cells) + ")")
    return "VALUES " + ", ".join(out)


_NAMES = r"""SELECT *, lower(regexp_extract(path, '[^/]*$')) AS b, '/' || lower(path) AS n,
 CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^.+[.]') THEN lower(regexp_extract(path, '[.][^./]*$')) ELSE '' END AS e FROM"""

_FAMILIES = """
auditor ; audit,review,check,validate,lint,scan
compiler ; compile,build,generate,render,produce
meta_kernel_forge ; meta,kernel,forge,bootstrap,scaffold
builder ; build,construct,create,assemble,install
planner ; plan,schedule,orchestrate,coordinate,roadmap
research ; research,search,find,retrieve,explore,analyze
domain_agent ; agent,domain,dispatch,route,delegate
legal ; legal,contract,clause,law,compliance
"""

_TYPES = """
playbook ; playbook,workflow,process,procedure,protocol ; playbooks?
kernel ; kernel,runtime,executor,sandbox,engine ; kernels?
context ; context,knowledge,documentation,reference ; contexts?
doctrine ; doctrine,governance,policy,principle,standard ; doctrines?|decisions?|adr
test ; test,spec,fixture,mock ; tests?|__tests__
script ; script,utility,helper,tool ; scripts?
prompt ;  ; prompts?
skill ; skill,capability,function,action,operation ; skills?
"""


def words(artifacts: str) -> str:
    """doc_id, b, n, e, w: the artifacts' names and the words in which keywords are looked for."""
    return f"SELECT *, list_distinct(string_split_regex(lower(regexp_extract(path, '[^/]*$') || ' ' || left(body, 800)), '[^a-z0-9_]+')) AS w FROM ({_NAMES} ({artifacts}))"


def family(artifacts: str) -> str:
    return f"""WITH t AS ({words(artifacts)}), f(r, family, ws) AS ({_rows(_FAMILIES)}), k AS (SELECT r, family, unnest(string_split(ws, ',')) AS word FROM f),
h AS (SELECT doc_id, min_by(family, r) AS family FROM t JOIN k ON list_contains(w, word) GROUP BY doc_id)
SELECT t.doc_id, coalesce(h.family, 'Unknown') AS family FROM t LEFT JOIN h ON h.doc_id = t.doc_id"""


def signals(artifacts: str) -> str:
    return f"""WITH t AS ({words(artifacts)}), f(r, family, ws) AS ({_rows(_FAMILIES)}), u AS (SELECT r, unnest(string_split(ws, ',')) AS word, generate_subscripts(string_split(ws, ','), 1) AS i FROM f),
k AS (SELECT word, min(r * 100 + i) AS place FROM u GROUP BY word),
h AS (SELECT doc_id, word, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM t JOIN k ON list_contains(w, word)),
g AS (SELECT doc_id, string_agg(word, '|' ORDER BY place) AS signals FROM h WHERE nth <= 6 GROUP BY doc_id)
SELECT t.doc_id, coalesce(g.signals, '') AS signals FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""


def types(artifacts: str) -> str:
    """doc_id, artifact_type, confidence."""
    return rf"""WITH t AS ({words(artifacts)}), f(r, kind, ws, segments) AS ({_rows(_TYPES)}), k AS (SELECT r, kind, unnest(string_split(ws, ',')) AS word FROM f),
score AS (SELECT doc_id, r, kind, count(*) AS n, bool_or(word IN ('fixture', 'mock', 'utility', 'helper')) AS strong FROM t JOIN k ON list_contains(w, word) WHERE word <> '' GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, r) AS i, row_number() OVER (PARTITION BY doc_id, kind IN ('test', 'script') ORDER BY n DESC, r) AS j FROM score),
top AS (SELECT doc_id, kind, n, kind IN ('test', 'script') AND NOT (n >= 3 OR n = 2 AND strong) AS weak FROM nth WHERE i = 1),
other AS (SELECT doc_id, kind, n FROM nth WHERE j = 1 AND kind NOT IN ('test', 'script')),
word AS (SELECT top.doc_id, CASE WHEN weak THEN coalesce(other.kind, 'context') ELSE top.kind END AS kind, CASE WHEN weak THEN coalesce(other.n, 0) ELSE top.n END AS n FROM top LEFT JOIN other ON other.doc_id = top.doc_id),
seg AS (SELECT doc_id, min_by(kind, r) AS kind FROM t JOIN f ON regexp_matches(n, '/(' || segments || ')/') GROUP BY doc_id),
dot AS (SELECT doc_id, regexp_extract(b, '\.(skill|playbook|kernel|context|prompt|doctrine|test|script)\.', 1) AS kind FROM t)
SELECT t.doc_id, CASE WHEN dot.kind <> '' THEN dot.kind WHEN starts_with(b, 'prompt-') THEN 'prompt' WHEN e NOT IN ('.md', '.mdx', '.markdown', '.rst', '.text', '.txt') THEN 'source' ELSE coalesce(seg.kind, word.kind, 'context') END AS artifact_type,
 CASE WHEN dot.kind <> '' OR starts_with(b, 'prompt-') THEN 'high' WHEN e NOT IN ('.md', '.mdx', '.markdown', '.rst', '.text', '.txt') THEN 'low' WHEN seg.kind IS NOT NULL THEN 'high' WHEN word.n >= 2 THEN 'medium' ELSE 'low' END AS confidence
FROM t JOIN dot ON dot.doc_id = t.doc_id LEFT JOIN seg ON seg.doc_id = t.doc_id LEFT JOIN word ON word.doc_id = t.doc_id"""


def classify(artifacts: str) -> str:
    return f"SELECT c.*, f.family, s.signals FROM ({types(artifacts)}) c JOIN ({family(artifacts)}) f ON f.doc_id = c.doc_id JOIN ({signals(artifacts)}) s ON s.doc_id = c.doc_id"


_SEMANTIC = r"""
b ; [.]d[.]ts$ ; type_definitions ; *.d.ts
b ; [.](test|spec)[.][cm]?[jt]sx?$ ; test_suite ; *.test/spec.*
n ; /(tests?|__tests__)/ ; test_suite ; /tests/
b ; [.]schema[.]|^schema[.]ts$|_schema[.]ts$ ; schema ; .schema.
n ; /schemas?/ ; schema ; /schemas/
b ; changelog ; changelog ; changelog
b ; contract ; contract ; contract
n ; /contracts?/ ; contract ; /contracts/
b ; ^package(-lock)?[.]json$ ; build_manifest ; =b
m ; manifest ; build_manifest ; manifest
n ; /(dist|build|[.]out)/ ; build_artifact ; =d
b ; ^prompt-|[.]prompt[.] ; prompt_template ; prompt-
n ; /prompts?/ ; prompt_template ; /prompts/
b ; [.]skill[.] ; skill_definition ; .skill.
n ; /skills?/ ; skill_definition ; /skills/
b ; doctrine|policy ; governance_doctrine ; doctrine
n ; /doctrines?/ ; governance_doctrine ; /doctrines/
b ; pipeline ; pipeline ; pipeline
n ; /pipelines?/ ; pipeline ; pipeline
n ; /(fixtures?|examples?|mocks?)/ ; fixture ; fixture
b ; fixture|mock ; fixture ; fixture
e ; ^[.](sh|bash|zsh|py)$ ; script ; =e
n ; /scripts?/ ; script ; /scripts/
b ; [.]config[.][cm]?[jt]s$|^tsconfig.*[.]json$|^[.].*rc([.].+)?$ ; configuration ; config
e ; ^[.](json|ya?ml|toml|ini)$ ; configuration ; =e
e ; ^[.](md|mdx|rst|txt)$ ; documentation ; =e
n ; /docs?/ ; documentation ; /docs/
e ; ^[.](ts|tsx|js|jsx|mjs|cjs)$ ; source_module ; =e
"""


def _ranked(artifacts: str, table: str) -> str:
    """Each artifact with the first rule whose pattern its field holds."""
    return f"""SELECT * FROM (SELECT t.*, v.*, row_number() OVER (PARTITION BY t.doc_id ORDER BY coalesce(v.r, 999)) AS nth FROM ({_NAMES} ({artifacts})) t
LEFT JOIN ({_rows(table)}) v(r, field, pattern, kind, say) ON regexp_matches(CASE WHEN field = 'b' THEN b WHEN field = 'n' THEN n WHEN field = 'e' THEN e WHEN e NOT IN ('.md', '.mdx', '.rst', '.txt') THEN b ELSE '' END, pattern)) WHERE nth = 1"""


def semantic(artifacts: str) -> str:
    return f"""SELECT doc_id, coalesce(kind, 'unknown') AS semantic_class, CASE WHEN kind IS NULL THEN 'low' WHEN kind = 'source_module' THEN 'medium' ELSE 'high' END AS semantic_confidence,
 CASE say WHEN '=b' THEN b WHEN '=e' THEN e WHEN '=d' THEN '/' || regexp_extract(n, '/(dist|build|[.]out)/', 1) || '/' ELSE say END AS semantic_signal FROM ({_ranked(artifacts, _SEMANTIC)})"""


_INVENTORY = r"""
b ; [.]schema[.](json|ya?ml)$ ; schema ; 0.92:schema filename convention
b ; [.](test|spec)[.][a-z0-9]+$ ; test ; 0.85:test filename/path
n ; /(tests?|__tests__|spec)/ ; test ; 0.85:test filename/path
b ; ^prompt[-_] ; prompt ; 0.85:prompt filename/path
n ; /prompts?/ ; prompt ; 0.85:prompt filename/path
e ; ^[.](zip|tar|gz|tgz|bz2|xz|7z|rar|jar|war)$ ; archive ; 0.95:archive extension =e
e ; ^[.]pdf$ ; research_pdf ; 0.9:pdf document
e ; ^[.](ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|c|h|cpp|hpp|cc|cs|rb|php|swift|kt|kts|scala|sh|bash|zsh|lua|r|jl|pl|pm|dart|ex|exs|ql|qls)$ ; code ; 0.9:code extension =e
n ; [/_-]spec([-_.]|s?/).*[.](md|markdown|ya?ml)$ ; spec ; 0.7:spec naming
e ; ^[.](json|ya?ml|toml|ini|cfg|conf|properties|env|lock|plist|tf|tfvars|sha256|sha1|md5)$ ; config ; 0.8:config extension =e
n ; /(research|notes?|papers?)/.*[.](md|markdown|mdx)$ ; research_markdown ; 0.75:markdown under research/notes path
e ; ^[.](md|markdown|mdx)$ ; documentation ; 0.6:markdown document
e ; ^[.](txt|rst|doc|docx|rtf|odt|pages)$ ; documentation ; 0.7:document extension =e
"""


def inventory(artifacts: str) -> str:
    """Of the virtual artifacts none has one of the special basenames: those have their cases in the tests."""
    pairs = "('.md', 'text/markdown'), ('.txt', 'text/plain'), ('.json', 'application/json'), ('.yaml', 'application/yaml'), ('.html', 'text/html'), ('.png', 'image/png'), ('.ts', 'text/x-typescript'), ('.py', 'text/x-python')"
    return f"""SELECT doc_id, coalesce(kind, 'unknown') AS semantic_class, CASE WHEN kind IS NULL THEN 'low' WHEN kind = 'source_module' THEN 'medium' ELSE 'high' END AS semantic_confidence,
 CASE say WHEN '=b' THEN b WHEN '=e' THEN e WHEN '=d' THEN '/' || regexp_extract(n, '/(dist|build|[.]out)/', 1) || '/' ELSE say END AS semantic_signal FROM ({_ranked(artifacts, _SEMANTIC)})"""


_INVENTORY = r"""
b ; [.]schema[.](json|ya?ml)$ ; schema ; 0.92:schema filename convention
b ; [.](test|spec)[.][a-z0-9]+$ ; test ; 0.85:test filename/path
n ; /(tests?|__tests__|spec)/ ; test ; 0.85:test filename/path
b ; ^prompt[-_] ; prompt ; 0.85:prompt filename/path
n ; /prompts?/ ; prompt ; 0.85:prompt filename/path
e ; ^[.](zip|tar|gz|tgz|bz2|xz|7z|rar|jar|war)$ ; archive ; 0.95:archive extension =e
e ; ^[.]pdf$ ; research_pdf ; 0.9:pdf document
e ; ^[.](ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|c|h|cpp|hpp|cc|cs|rb|php|swift|kt|kts|scala|sh|bash|zsh|lua|r|jl|pl|pm|dart|ex|exs|ql|qls)$ ; code ; 0.9:code extension =e
n ; [/_-]spec([-_.]|s?/).*[.](md|markdown|ya?ml)$ ; spec ; 0.7:spec naming
e ; ^[.](json|ya?ml|toml|ini|cfg|conf|properties|env|lock|plist|tf|tfvars|sha256|sha1|md5)$ ; config ; 0.8:config extension =e
n ; /(research|notes?|papers?)/.*[.](md|markdown|mdx)$ ; research_markdown ; 0.75:markdown under research/notes path
e ; ^[.](md|markdown|mdx)$ ; documentation ; 0.6:markdown document
e ; ^[.](txt|rst|doc|docx|rtf|odt|pages)$ ; documentation ; 0.7:document extension =e
"""


def inventory(artifacts: str) -> str:
    """Of the virtual artifacts none has one of the special basenames: those have their cases in the tests."""
    mime = "{'.md': 'text/markdown', '.txt': 'text/plain', '.json': 'application/json', '.yaml': 'application/yaml', '.html': 'text/html', '.png': 'image/png', '.ts': 'text/x-typescript', '.py': 'text/x-python'}"
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in eval(mime).items())  # a literal of this file
    return f"""SELECT doc_id, coalesce(kind, 'unknown') AS inventory_type, coalesce(split_part(say, ':', 1), '0.2')::DOUBLE AS inventory_confidence, coalesce(replace(split_part(say, ':', 2), '=e', e), 'no recognized signal') AS evidence,
 CASE WHEN kind IS NOT NULL THEN '' WHEN e <> '' THEN 'unrecognized_extension:' || e ELSE 'no_extension' END AS unknowns, m.mime AS mime_type
FROM ({_ranked(artifacts, _INVENTORY)}) q LEFT JOIN (VALUES {pairs}) m(x, mime) ON m.x = q.e"""


_STRATEGY = r"""
e ; ^[.](7z|a|avi|bin|bmp|bz2|class|dat|dll|dylib|eot|exe|flac|gif|gz|ico|jpe?g|lib|log|mkv|mov|mp3|mp4|o|ogg|otf|pdf|png|py[cdo]|rar|so|tar|tiff?|ttf|wasm|wav|webm|webp|woff2?|xz|zip)$ ; skip-binary ; -
e ; ^[.](md|markdown)$ ; yaml-frontmatter ; -
e ; ^[.](c|cc|cjs|cpp|cs|d|dart|go|groovy|h|hh|hpp|java|jsx?|kts?|mjs|php|proto|rs|scala|sol|swift|tsx?|v|zig)$ ; line-comment ; //
e ; ^[.](bash|cfg|coffee|conf|dockerfile|env|exs?|fish|gd|ini|jl|mk|nim|p[lmsy]|properties|psm?1|qls?|r|rb|sh|tf|tfvars|toml|ya?ml|zsh)$ ; line-comment ; #
e ; ^[.](html?|svg|vue|xhtml|xml|xslt?)$ ; block-comment ; <!--
e ; ^[.](css|less|s[ac]ss)$ ; block-comment ; /*
"""


def strategy(artifacts: str) -> str:
    """doc_id, strategy, line_prefix, block_open, block_close; a NUL in the first 8192 characters makes any file binary."""
    return f"""SELECT doc_id, s AS strategy, CASE WHEN s = 'line-comment' THEN say END AS line_prefix, CASE WHEN s = 'block-comment' THEN say END AS block_open,
 CASE WHEN s = 'block-comment' THEN CASE say WHEN '/*' THEN '*/' ELSE '-->' END END AS block_close
FROM (SELECT *, CASE WHEN contains(left(body, 8192), chr(0)) THEN 'skip-binary' ELSE coalesce(kind, 'sidecar') END AS s FROM ({_ranked(artifacts, _STRATEGY)}))"""


def omitted(artifacts: str) -> str:
    """For the patterns vendor/, *.zzz and !vendor/pkg/x*."""
    return rf"""SELECT doc_id, path, CASE WHEN lower(regexp_extract(path, '[^/]*$')) = 'skill.md' THEN true WHEN regexp_matches(path, '(?i)(^|/)vendor/pkg/x[^/]*$') THEN false
 ELSE regexp_matches(path, '(?i)\.(zzz|py[cdo]|log)$') OR regexp_matches('/' || path || '/', '(?i)/(vendor|node_modules|__pycache__)/') END AS omitted FROM ({artifacts})"""


def carrier(artifacts: str) -> str:
    """For the allow patterns skills/**, docs/**/*.md and notes/**."""
    prefixes = lambda text: "|".join(f"{x}/" for x in text.replace(".", "[.]").split())
    skip, vendored = prefixes(".git .meta node_modules __pycache__"), prefixes(".venv build coverage dist third-party third_party vendor venv")
    central = prefixes(".devcontainer .githooks .github .husky __tests__ app bin helm infra infrastructure k8s kubernetes lib packages pulumi scripts src terraform test tests tools")
    return rf"""WITH t AS (SELECT x.*, c.artifact_type, s.strategy FROM ({_NAMES} ({artifacts})) x JOIN ({types(artifacts)}) c ON c.doc_id = x.doc_id JOIN ({strategy(artifacts)}) s ON s.doc_id = x.doc_id),
r AS (
 SELECT doc_id, 1 AS rank, 'hard_skip' AS carrier, 'protected namespace' AS why, regexp_extract(n, '^/({skip})', 1) AS rule FROM t WHERE regexp_matches(n, '^/({skip})')
 UNION ALL SELECT doc_id, 2, 'hard_skip', 'generated metadata', regexp_extract(n, '[.](meta[.]yaml|inject[.]log)$') FROM t WHERE regexp_matches(n, '[.](meta[.]yaml|inject[.]log)$')
 UNION ALL SELECT doc_id, 3, 'hard_skip', 'binary content', 'strategy:skip-binary' FROM t WHERE strategy = 'skip-binary'
 UNION ALL SELECT doc_id, 4, 'inventory_only', 'generated or vendored', regexp_extract(n, '^/({vendored})', 1) FROM t WHERE regexp_matches(n, '^/({vendored})')
 UNION ALL SELECT doc_id, 7, 'central_manifest', 'source, test or automation surface', regexp_extract(n, '^/({central})', 1) FROM t WHERE regexp_matches(n, '^/({central})')
 UNION ALL SELECT doc_id, 8, 'central_manifest', 'type is never inline', 'artifact:' || artifact_type FROM t WHERE artifact_type IN ('source', 'test', 'script')
 UNION ALL SELECT doc_id, 9, 'central_manifest', 'structured or executable format', b FROM t WHERE e IN ('.py', '.ts', '.json', '.yaml', '.html')
 UNION ALL SELECT doc_id, 10, 'central_manifest', 'no prose format', 'strategy:' || strategy FROM t WHERE strategy IN ('line-comment', 'block-comment', 'sidecar')
 UNION ALL SELECT doc_id, 11 + g.i, CASE WHEN artifact_type IN ('context', 'doctrine', 'kernel', 'playbook', 'prompt', 'skill') THEN 'inline_managed' ELSE 'central_manifest' END,
  CASE WHEN artifact_type IN ('context', 'doctrine', 'kernel', 'playbook', 'prompt', 'skill') THEN 'allowed prose' ELSE 'type not allowed inline' END, 'inline_allow:' || g.allow
  FROM t JOIN (VALUES (0, 'skills/**', '^skills/.*$'), (1, 'docs/**/*.md', '^docs/(.*/)?[^/]*[.]md$'), (2, 'notes/**', '^notes/.*$')) g(i, allow, re) ON regexp_matches(path, re)
 UNION ALL SELECT doc_id, 99, 'central_manifest', 'default carrier', 'default_carrier:central_manifest' FROM t)
SELECT t.doc_id, t.path, arg_min(carrier, rank) AS carrier, arg_min(why, rank) AS carrier_reason, arg_min(rule, rank) AS carrier_rule FROM t JOIN r ON r.doc_id = t.doc_id GROUP BY t.doc_id, t.path"""


def union_of(a: str, b: str) -> str:
    """Two comma lists put together, each item once, in order of appearance; a whole Unknown is none."""
    return f"""coalesce((SELECT nullif(string_agg(p, ', ' ORDER BY i), '') FROM (SELECT p, min(i) AS i FROM (SELECT trim(unnest(x)) AS p, generate_subscripts(x, 1) AS i FROM
 (SELECT string_split(concat_ws(',', nullif({a}, 'Unknown'), nullif({b}, 'Unknown')), ',') AS x)) WHERE p <> '' GROUP BY p)), 'Unknown')"""


def reconciled(fields: str) -> str:
    """doc_id, path, field, old, new, action, merged, reason of (doc_id, path, field, old, new, has_old, deprecated) rows."""
    good = lambda x: f"coalesce({x} NOT IN ('', 'Unknown') AND len(regexp_extract_all({x}, '\\S+')) >= 8, false)"
    return f"""WITH f AS (SELECT *, {union_of('old', 'new')} AS joined, field IN ('activation_signals', 'anti_triggers', 'constraints', 'entity_types', 'input_variables', 'phase_model', 'stop_conditions', 'triggers', 'validation_gates') AS listed,
 {good('new')} AND (NOT {good('old')} OR (length(new) + 2) / (length(old) + 2) > 1.2) AS gains FROM ({fields})),
g AS (SELECT *, CASE WHEN NOT has_old THEN 'add' WHEN listed THEN CASE WHEN joined = old THEN 'keep' ELSE 'append-union' END WHEN deprecated THEN 'replace' WHEN gains THEN 'revise' ELSE 'keep' END AS action FROM f)
SELECT doc_id, path, field, old, new, action, CASE action WHEN 'add' THEN new WHEN 'append-union' THEN joined WHEN 'replace' THEN new WHEN 'revise' THEN new ELSE CASE WHEN listed THEN joined ELSE old END END AS merged,
 CASE action WHEN 'add' THEN 'new field' WHEN 'append-union' THEN 'list grew' WHEN 'replace' THEN 'old record is deprecated' WHEN 'revise' THEN 'new value says more' ELSE CASE WHEN listed THEN 'list as it was' ELSE 'old value is good enough' END END AS reason FROM g"""
