"""Rule tables as data. Where a table is a set, it is in alphabetical order; where order decides, it says so."""

from __future__ import annotations


def dotted(names: str) -> tuple[str, ...]:
    return tuple("." + n for n in names.split())


PROSE = dotted("markdown md mdx rst text txt")
FRONTMATTER = dotted("markdown md")

#: First family with a word wins; signals are listed in this order.
FAMILIES = {
    "auditor": "audit review check validate lint scan",
    "compiler": "compile build generate render produce",
    "meta_kernel_forge": "meta kernel forge bootstrap scaffold",
    "builder": "build construct create assemble install",
    "planner": "plan schedule orchestrate coordinate roadmap",
    "research": "research search find retrieve explore analyze",
    "domain_agent": "agent domain dispatch route delegate",
    "legal": "legal contract clause law compliance",
}

#: First of equal scores wins; words, then path segments.
TYPES = {
    "playbook": ("playbook workflow process procedure protocol", "playbooks playbook"),
    "kernel": ("kernel runtime executor sandbox engine", "kernels kernel"),
    "context": ("context knowledge documentation reference", "contexts context"),
    "doctrine": ("doctrine governance policy principle standard", "doctrines doctrine decisions decision adr"),
    "test": ("test spec fixture mock", "tests test __tests__"),
    "script": ("script utility helper tool", "scripts script"),
    "prompt": ("", "prompts prompt"),
    "skill": ("skill capability function action operation", "skills skill"),
}
STRONG = {"test": ("fixture", "mock"), "script": ("helper", "utility")}

#: artifact type: MCP primitive, callable, injectable.
TAXONOMY = {
    "skill": ("tool", True, True),
    "playbook": ("tool", True, True),
    "kernel": ("tool", True, True),
    "context": ("resource", True, True),
    "prompt": ("prompt", True, True),
    "doctrine": ("none", False, True),
    "source": ("resource", False, True),
    "test": ("none", False, False),
    "script": ("none", False, False),
    "unknown": ("none", False, False),
}

#: class: (directory, layer, coarse type)
CLASSES = {
    "source_module": ("src", "implementation", "source"),
    "type_definitions": ("src/types", "implementation", "source"),
    "test_suite": ("tests", "verification", "test"),
    "schema": ("schemas", "contract", "source"),
    "configuration": ("config", "operations", "source"),
    "documentation": ("docs", "documentation", "context"),
    "contract": ("docs/contracts", "contract", "doctrine"),
    "build_manifest": (".", "operations", "source"),
    "build_artifact": ("dist", "build", "source"),
    "fixture": ("tests/fixtures", "verification", "test"),
    "script": ("scripts", "operations", "script"),
    "pipeline": ("src/pipeline", "implementation", "script"),
    "prompt_template": ("prompts", "content", "prompt"),
    "skill_definition": ("skills", "content", "skill"),
    "governance_doctrine": ("doctrines", "governance", "doctrine"),
    "changelog": (".", "documentation", "context"),
    "unknown": ("99_CONFLICTS_AND_UNKNOWN", "quarantine", "unknown"),
}
QUARANTINE = "99_CONFLICTS_AND_UNKNOWN"

INVENTORY_TYPES = {
    "archive": "unknown", "code": "source", "config": "source", "documentation": "context", "folder": "unknown", "prompt": "prompt",
    "research_markdown": "context", "research_pdf": "context", "schema": "source", "spec": "context", "test": "test", "unknown": "unknown",
}

CODE = dotted("bash c cc cjs cpp cs dart ex exs go h hpp java jl js jsx kt kts lua mjs php pl pm py ql qls r rb rs scala sh swift ts tsx zsh")
CONFIG = dotted("cfg conf env ini json lock md5 plist properties sha1 sha256 tf tfvars toml yaml yml")
ARCHIVES = dotted("7z bz2 gz jar rar tar tgz war xz zip")
DOCUMENTS = dotted("doc docx odt pages rst rtf txt")
MIME = {
    "application/json": "json", "application/pdf": "pdf", "application/yaml": "yaml yml", "application/zip": "zip", "audio/mpeg": "mp3", "image/gif": "gif",
    "image/jpeg": "jpeg jpg", "image/png": "png", "image/svg+xml": "svg", "text/csv": "csv", "text/html": "html", "text/javascript": "js", "text/markdown": "md",
    "text/plain": "txt", "text/x-python": "py", "text/x-typescript": "ts", "application/xml": "xml", "video/mp4": "mp4",
}
#: basename: (type, confidence, evidence)
BASENAMES = {
    **{b: ("config", 0.85, e) for b, e in ((".dockerignore", "docker ignore file"), (".editorconfig", "editorconfig file"), (".gitattributes", "git attributes file"), (".gitignore", "git ignore file"), (".npmignore", "npm ignore file"), ("codeowners", "CODEOWNERS file"), ("manifest.sha256", "checksum manifest"))},
    **{b: ("documentation", 0.8, "license file") for b in ("license", "license.md", "license.txt")},
    "copying": ("documentation", 0.75, "copying/license file"),
    "notice": ("documentation", 0.75, "notice file"),
}

BINARY = dotted("7z a avi bin bmp bz2 class dat dll dylib eot exe flac gif gz ico jpeg jpg lib log mkv mov mp3 mp4 o ogg otf pdf png pyc pyd pyo rar so tar tif tiff ttf wasm wav webm webp woff woff2 xz zip")
#: comment prefix: extensions
LINE_COMMENTS = {
    "//": dotted("c cc cjs cpp cs d dart go groovy h hh hpp java js jsx kt kts mjs php proto rs scala sol swift ts tsx v zig"),
    "#": dotted("bash cfg coffee conf dockerfile env ex exs fish gd ini jl mk nim pl pm properties ps1 psm1 py ql qls r rb sh tf tfvars toml yaml yml zsh"),
    "--": dotted("adb ads elm hs lua sql"),
    ";": dotted("asm clj cljc cljs el lisp s scm"),
    "%": dotted("erl m tex"),
}
LINE_BASENAMES = (".bashrc", ".dockerignore", ".editorconfig", ".env", ".gitattributes", ".gitignore", ".npmignore", ".profile", ".zshrc", "brewfile", "codeowners", "dockerfile", "gemfile", "gnumakefile", "makefile", "procfile", "rakefile", "vagrantfile")
BLOCK_COMMENTS = {("<!--", "-->"): dotted("htm html svg vue xhtml xml xsl xslt"), ("/*", "*/"): dotted("css less sass scss")}

# carriers: tier by tier; of one tier at most one prefix can hold
CONTROL = ".meta"
SKIP_PREFIXES = (".git/", CONTROL + "/", "node_modules/", "__pycache__/")
INVENTORY_PREFIXES = tuple(p + "/" for p in ".venv build coverage dist third-party third_party vendor venv".split())
CENTRAL_PREFIXES = tuple(p + "/" for p in ".devcontainer .githooks .github .husky __tests__ app bin helm infra infrastructure k8s kubernetes lib packages pulumi scripts src terraform test tests tools".split())
GENERATED = (".meta.yaml", ".inject.log")
LOCKS = tuple("bun.lock bun.lockb cargo.lock composer.lock go.sum npm-shrinkwrap.json package-lock.json pdm.lock pipfile.lock pnpm-lock.yaml poetry.lock yarn.lock".split())
CENTRAL_BASENAMES = tuple(".dockerignore .editorconfig .gitattributes .gitignore .npmignore codeowners compose.yaml compose.yml deno.json deno.jsonc docker-compose.yaml docker-compose.yml dockerfile gnumakefile jsconfig.json makefile package.json pyproject.toml requirements.txt setup.cfg setup.py tsconfig.json".split())
CENTRAL_EXTENSIONS = dotted("bash c cc cfg cjs conf cpp cs css csv dart fish geojson go gql graphql h hcl hpp htm html ini java jl js json json5 jsonc jsx kt kts less lua mjs php pl pm properties proto ps1 py r rb rs sass scala scss sh sql swift tf tfvars toml ts tsv tsx xml yaml yml zsh")
INLINE_TYPES = ("context", "doctrine", "kernel", "playbook", "prompt", "skill")

NOISE = ("__pycache__/", "*.pyc", "*.pyo", "*.pyd", "*.log")
SKILL_PROTECT = ("**/SKILL.md", "**/skill.md")
DISPOSITIONS = ("binary_detected", "eligible", "extension_filtered", "generated_artifact", "hidden_control", "known_binary", "omitted", "symlink", "traversed_directory", "unreadable", "unsupported_encoding", "unsupported_entry")
BLOCKING = ("symlink", "unreadable", "unsupported_entry")
UNION_FIELDS = ("activation_signals", "anti_triggers", "constraints", "entity_types", "input_variables", "phase_model", "stop_conditions", "triggers", "validation_gates")

#: first key in path or text wins: (type, domain, directory, confidence)
_DESIGN = {"constellation": "", "packet": "-envelope", "chassis": "", "control-plane": ""}
DOMAIN_HINTS = {k: ("architecture", k + tail, f"01_ARCHITECTURE/{k}{tail}", 0.85) for k, tail in _DESIGN.items()}
DOMAIN_HINTS |= {k: ("contract", "node-contracts", "02_NODE_CONTRACTS" + sub, c) for k, sub, c in (("registration", "/registration", 0.82), ("node_contract", "", 0.8))}
DOMAIN_HINTS["infrastructure"] = ("infra", "infrastructure", "04_INFRASTRUCTURE", 0.8)
DOMAIN_HINTS |= {k: (k, "generic", f"05_TEMPLATES_AND_SKILLS/{k}s", 0.78) for k in ("template", "skill")}
LOW_CONFIDENCE = "99_CONFLICTS_AND_UNKNOWN/low-confidence"
