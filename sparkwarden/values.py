"""Fixed values.

Detection patterns, word lists, thresholds and label maps whose exact content decides the
results.  They are data, kept together and in their natural order; no logic lives here.
Patterns carry no inline flags: ``functions.patterns`` adds the flags each engine needs.
"""

# --------------------------------------------------------------------------------------
# Severity scales
# --------------------------------------------------------------------------------------
SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
OUTCOMES = ["safe", "needs_review", "malicious", "error"]

# --------------------------------------------------------------------------------------
# Detection rules: id, severity, description, tags, anchor, pattern
# (scope "any", ecosystem "*", case-insensitive unless listed in CASE_SENSITIVE_RULES).
# "anchor" lists lower-case literals that every match must contain (a nested list means "one
# of"); anchors are ours and only serve as a cheap necessary test before the regular expression.
# --------------------------------------------------------------------------------------
RULES = [
    ("eval-call", "medium", "Dynamic code execution via eval()", ["execution", "dynamic"], ["eval"], r"\beval\s*\("),
    ("exec-call", "medium", "Dynamic code execution via exec()", ["execution", "dynamic"], ["exec"], r"\bexec\s*\("),
    ("dunder-import", "medium", "Dynamic import via __import__()", ["execution", "dynamic"], ["__import__"], r"\b__import__\s*\("),
    ("subprocess-call", "medium", "Subprocess invocation", ["execution", "subprocess"], ["subprocess"], r"\bsubprocess\b"),
    ("os-system", "high", "Shell command execution via os.system()", ["execution", "shell"], ["os.system"], r"\bos\.system\s*\("),
    ("os-popen", "high", "Shell command execution via os.popen()", ["execution", "shell"], ["os.popen"], r"\bos\.popen\s*\("),
    ("compile-exec", "high", "compile() + exec pattern — staged code execution", ["execution", "obfuscation"], ["compile", "exec"], r"\bcompile\s*\(.*exec"),
    ("importlib-import", "medium", "Dynamic import via importlib.import_module()", ["execution", "dynamic"], ["importlib.import_module"], r"\bimportlib\.import_module\s*\("),
    ("getattr-os", "high", "Dynamic attribute access on os module", ["execution", "dynamic"], ["getattr"], r"\bgetattr\s*\(\s*os\b"),
    ("ctypes-cdll", "high", "Native code loading via ctypes.CDLL", ["execution", "native"], ["ctypes.cdll"], r"\bctypes\.CDLL\b"),
    ("marshal-loads", "high", "Deserialization via marshal.loads() — can execute arbitrary code", ["execution", "deserialization"], ["marshal.loads"], r"\bmarshal\.loads\s*\("),
    ("requests-get-post", "medium", "HTTP request via requests library", ["exfiltration", "network"], ["request"], r"requests?\.(get|post|put)\s*\("),
    ("urllib-urlopen", "medium", "HTTP request via urllib.urlopen", ["exfiltration", "network"], ["urllib.request.urlopen"], r"urllib\.request\.urlopen"),
    ("httpx-get-post", "medium", "HTTP request via httpx", ["exfiltration", "network"], ["http"], r"httpx?\.(get|post)\s*\("),
    ("socket-connect", "medium", "Raw socket connection", ["exfiltration", "network"], ["socket", "connect"], r"\bsocket\b.*connect"),
    ("socket-getaddrinfo", "medium", "DNS lookup via socket.getaddrinfo — potential DNS exfiltration", ["exfiltration", "dns"], ["socket.getaddrinfo"], r"\bsocket\.getaddrinfo\s*\("),
    ("socket-create-connection", "medium", "Network connection via socket.create_connection", ["exfiltration", "network"], ["socket.create_connection"], r"\bsocket\.create_connection\s*\("),
    ("dns-resolver", "medium", "DNS resolution via dns.resolver — potential DNS exfiltration", ["exfiltration", "dns"], ["dns.resolver"], r"\bdns\.resolver\b"),
    ("process-exit", "medium", "Process termination — protestware / denial of service", ["install_hook", "termination"], ["process.exit"], r"\bprocess\.exit\s*\("),
    ("os-exit", "medium", "Immediate process termination via os._exit()", ["install_hook", "termination"], ["os._exit"], r"\bos\._exit\s*\("),
    ("os-kill", "medium", "Process killing via os.kill()", ["install_hook", "termination"], ["os.kill"], r"\bos\.kill\s*\("),
    ("node-execsync", "high", "Node.js synchronous command execution", ["execution", "node", "shell"], ["execsync"], r"\bexecSync\s*\("),
    ("node-spawn", "medium", "Node.js child process spawn", ["execution", "node"], ["spawn"], r"\bspawn\s*\("),
    ("node-fs-write", "medium", "Node.js file system write operation", ["filesystem", "node", "persistence"], ["fs."], r"\bfs\.(?:writeFileSync|writeFile|appendFileSync)\s*\("),
    ("node-https-get", "medium", "Node.js native HTTP/HTTPS request", ["exfiltration", "network", "node"], ["http"], r"\bhttps?\.(?:get|request)\s*\("),
    ("node-buffer-base64", "medium", "Base64 decoding via Buffer.from — common obfuscation technique", ["obfuscation", "node"], ["buffer.from", "base64"], r"Buffer\.from\s*\([^)]*[\"\x27]base64[\"\x27]"),
    ("node-process-env-write", "low", "Environment variable modification", ["credential_access", "node"], ["process.env."], r"process\.env\.\w+\s*="),
    ("child-process", "high", "Node.js child_process — shell command execution", ["execution", "node"], ["child_process"], r"\bchild_process\b"),
    ("process-binding", "high", "Node.js process.binding — low-level API access", ["execution", "node"], ["process.binding"], r"\bprocess\.binding\s*\("),
    ("constructor-constructor", "high", "Constructor chain — sandbox escape technique", ["execution", "node", "sandbox_escape"], [".constructor.constructor"], r"\.constructor\.constructor\s*\("),
    ("new-function", "high", "Dynamic function creation via new Function()", ["execution", "node", "dynamic"], ["new", "function"], r"\bnew\s+Function\s*\("),
    ("base64-decode", "medium", "Base64 decoding — common obfuscation technique", ["obfuscation", "encoding"], ["base64.b64decode"], r"base64\.b64decode"),
    ("webbrowser-open", "low", "Browser open — can redirect to phishing or malicious URLs", ["obfuscation", "browser"], ["webbrowser.open"], r"\bwebbrowser\.open\s*\("),
    ("string-reverse-decode", "high", "String reversal — common payload deobfuscation technique", ["obfuscation", "node"], [".split", ".reverse"], r"\.split\s*\([\"\x27]{2}\)\s*\.reverse\s*\(\)\s*\.join"),
    ("xor-decode", "medium", "XOR decoding — custom cipher used in malware", ["obfuscation"], [["xor", "^"]], r"\bxor\b|\^=?\s*(?:key|secret|constant|salt)"),
    ("macos-persistence-path", "high", "macOS persistence path — LaunchAgent, LaunchDaemon, or Cache binary", ["persistence", "macos", "filesystem"], ["/library/"], r"/Library/(?:Caches|LaunchAgents|LaunchDaemons|Application Support)/[^\"\s]+"),
    ("linux-tmp-executable", "high", "Executable dropped in /tmp — common malware staging", ["persistence", "linux", "filesystem"], ["/tmp/"], r"/tmp/[^\"\s]+\.(?:py|sh|bin|elf)"),
    ("windows-programdata", "medium", "Windows persistence path", ["persistence", "windows", "filesystem"], ["data%"], r"%PROGRAMDATA%|%APPDATA%|%LOCALAPPDATA%"),
    ("chmod-executable", "medium", "Making file executable — potential payload deployment", ["execution", "persistence"], ["chmod"], r"chmod\s+\+x\b"),
]
CASE_SENSITIVE_RULES = ["xor-decode"]

# Tag combinations inside one file: id, required tags, minimum hits, severity, description
COMPOUND_RULES = [
    ("exec-plus-cred-theft", ["execution", "credential_access"], 2, "MEDIUM", "Code execution + credential file access in same file"),
    ("exec-plus-exfiltration", ["execution", "exfiltration"], 2, "HIGH", "Code execution + network exfiltration in same file"),
    ("obfuscation-plus-exfiltration", ["obfuscation", "exfiltration"], 2, "HIGH", "Obfuscated code + network call in same file"),
    ("full-attack-chain", ["execution", "credential_access", "exfiltration"], 3, "CRITICAL", "Execution + credential access + exfiltration"),
]

# Behaviours and their patterns (case-insensitive): (anchor literals, pattern)
BEHAVIOURS = {
    "download": [
        (["urllib.request.urlopen"], r"\burllib\.request\.urlopen\b"),
        (["urlopen"], r"\burlopen\s*\("),
        (["urllib", "urlretrieve"], r"\burllib\b.*\burlretrieve\b"),
        (["request", ".get"], r"\brequests?\.\bget\b"),
        (["http", ".get"], r"\bhttpx?\.\bget\b"),
        (["http"], r"\bhttps?\.\b(?:get|request)\b"),
        (["fetch"], r"\bfetch\s*\("),
        (["curl"], r"\bcurl\b"),
        (["wget"], r"\bwget\b"),
        (["socket"], r"\bsocket\b.*\b(?:connect|getaddrinfo)\b"),
        (["dns", "resolv"], r"\bdns\b.*\bresolv"),
    ],
    "decode": [
        (["base64", "decode"], r"\bbase64\b.*\b(?:b64decode|decode)\b"),
        (["buffer.from", "base64"], r"Buffer\.from\b.*base64"),
        ([".split(", ".reverse().join"], r"\.split\(['\"].*\)\.reverse\(\)\.join"),
        (["atob"], r"\batob\s*\("),
        (["xor"], r"\bxor\b"),
        (["marshal.loads"], r"\bmarshal\.loads\b"),
        (["pickle.loads"], r"\bpickle\.loads\b"),
        (["zlib.decompress"], r"\bzlib\.decompress\b"),
        (["string.fromcharcode"], r"\bString\.fromCharCode\b"),
    ],
    "write": [
        (["open"], r"\bopen\s*\(.*['\"]w"),
        (["fs."], r"\bfs\.(?:writeFileSync|writeFile|appendFile)\b"),
        (["shutil.copy"], r"\bshutil\.copy\b"),
        (["os.re"], r"\bos\.(?:rename|replace)\b"),
    ],
    "execute": [
        (["exec"], r"\bexec\s*\("),
        (["eval"], r"\beval\s*\("),
        (["execsync"], r"\bexecSync\s*\("),
        (["subprocess"], r"\bsubprocess\b"),
        (["os.system"], r"\bos\.system\s*\("),
        (["os.popen"], r"\bos\.popen\s*\("),
        (["child_process"], r"\bchild_process\b"),
        (["__import__"], r"\b__import__\s*\("),
        (["function"], r"\bFunction\s*\("),
    ],
    "persist": [
        (["/library/"], r"/Library/(?:Caches|LaunchAgents|LaunchDaemons)"),
        ([".pth"], r"\.pth\b"),
        (["crontab"], r"crontab"),
        (["systemd"], r"systemd"),
        (["launchagent"], r"LaunchAgent"),
        (["hkey_"], r"HKEY_"),
        (["chmod"], r"chmod\s+\+x"),
        (["/tmp/"], r"/tmp/.*\.(?:py|sh|bin)"),
        (["%programdata%"], r"%PROGRAMDATA%"),
        (["%appdata%"], r"%APPDATA%"),
        (["autostart"], r"autostart"),
    ],
    "exfiltrate": [
        ([".post"], r"\b(?:requests?|httpx?)\.post\s*\("),
        (["urllib.request.urlopen", "data="], r"urllib\.request\.urlopen.*data="),
        (["webhook"], r"webhook"),
        (["discord.com/api/webhooks"], r"discord\.com/api/webhooks"),
        (["telegram.org/bot"], r"telegram\.org/bot"),
    ],
    "credential_access": [
        ([".ssh/"], r"\.ssh/"),
        ([".aws/"], r"\.aws/"),
        ([".env"], r"\.env\b"),
        ([".npmrc"], r"\.npmrc\b"),
        ([".pypirc"], r"\.pypirc\b"),
        ([["github_token", "npm_token", "aws_secret"]], r"GITHUB_TOKEN|NPM_TOKEN|AWS_SECRET"),
        (["keychain"], r"keychain"),
        ([".gnupg/"], r"\.gnupg/"),
        ([".kube/config"], r"\.kube/config"),
    ],
}

# Attack chains: id, required behaviours, severity, description
ATTACK_CHAINS = [
    ("dropper", ["download", "execute"], "HIGH", "Download and execute remote payload"),
    ("encoded-dropper", ["download", "decode", "execute"], "CRITICAL", "Download, decode, and execute obfuscated payload"),
    ("rat-deployment", ["download", "write", "execute", "persist"], "CRITICAL", "Download, write, execute, and persist (RAT)"),
    ("credential-theft", ["credential_access", "exfiltrate"], "CRITICAL", "Access credentials and exfiltrate"),
    ("staged-credential-theft", ["credential_access", "decode", "exfiltrate"], "CRITICAL", "Access credentials, encode, and exfiltrate"),
    ("obfuscated-execution", ["decode", "execute"], "HIGH", "Decode obfuscated payload and execute"),
    ("persistent-backdoor", ["execute", "persist"], "CRITICAL", "Execute and establish persistence"),
    ("full-attack-chain", ["download", "decode", "write", "execute", "persist"], "CRITICAL", "Complete attack: download -> decode -> write -> execute -> persist"),
]

# --------------------------------------------------------------------------------------
# File classes
# --------------------------------------------------------------------------------------
INSTALL_NAMES = ["setup.py", "setup.cfg", "postinstall.js", "preinstall.js", "install.js", "prepare.js", "build.rs"]
ROOT_INSTALL_NAMES = ["conftest.py", "__main__.py", "Makefile", "CMakeLists.txt", "__init__.py", "setup.js"]
SKIP_DIRS = [".github", ".circleci", ".gitlab", ".travis", ".jenkins", "__pycache__", "node_modules", ".git"]
SKIP_SUFFIXES = [".md", ".rst", ".txt", ".html", ".css", ".yml", ".yaml", ".toml", ".cfg", ".ini", ".json", ".lock"]

ARCHIVE_TEXT_SUFFIXES = [
    ".dart", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".txt", ".md", ".rst", ".sh",
    ".bat", ".pth", ".rs", ".swift", ".m", ".mm", ".h", ".c", ".cc", ".cpp", ".podspec", ".gitattributes",
]
ARCHIVE_TEXT_BASENAMES = [".gitattributes"]
TREE_PRUNED_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv"]
TREE_SNIFF_SUFFIXES = [".md", ".rst", ".txt", ".csv", ".json", ".yml", ".yaml", ".toml", ".lock", ".png", ".jpg", ".gif", ".ico"]

MAX_FILE_BYTES = 512 * 1024
MAX_ARCHIVE_TOTAL_BYTES = 100 * 1024 * 1024
MAX_TREE_TOTAL_BYTES = 50 * 1024 * 1024
MAX_MANIFEST_MEMBERS = 5_000
MAX_MANIFEST_BYTES = 10 * 1024 * 1024
MANIFEST_HEAD_BYTES = 64 * 1024

# --------------------------------------------------------------------------------------
# Content sniffing
# --------------------------------------------------------------------------------------
SHEBANGS = [
    ("python", r"\bpython[23]?\b"),
    ("javascript", r"\bnode\b"),
    ("shell", r"\b(?:ba)?sh\b"),
    ("perl", r"\bperl\b"),
    ("ruby", r"\bruby\b"),
    ("php", r"\bphp\b"),
]
PYTHON_PROBE = (
    r"(?:^import\s+\w+|^from\s+\w+\s+import\s+|^(?:def|class)\s+\w+\s*[\(:]|"
    r"^if\s+__name__\s*==\s*['\"]__main__['\"])"
)
JS_PROBE = (
    r"(?:\brequire\s*\(['\"]|\bmodule\.exports\b|^import\s+\{?\s*\w+.*\bfrom\s+['\"]|"
    r"^export\s+(?:default|const|function|class)\b)"
)
CODE_TYPES = ["python", "javascript", "shell", "ruby", "perl", "php"]
SUFFIX_TYPES = {
    ".py": "python", ".pyw": "python", ".pth": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "javascript",
    ".sh": "shell", ".bash": "shell", ".bat": "shell", ".cmd": "shell",
    ".rb": "ruby", ".pl": "perl", ".php": "php", ".dart": "dart",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".cfg": "config", ".ini": "config", ".md": "markdown", ".rst": "markdown",
    ".txt": "text", ".html": "html", ".css": "css",
}

# --------------------------------------------------------------------------------------
# Ecosystem-specific file risks
# --------------------------------------------------------------------------------------
BUILD_SCRIPT_PATTERNS = [
    ("reqwest", r"\breqwest\b"),
    ("ureq", r"\bureq\b"),
    ("hyper", r"\bhyper\b"),
    ("std::net", r"\bstd::net::"),
    ("TcpStream", r"\bTcpStream\b"),
    ("Command(curl/wget/sh)", r"\bCommand::new\s*\(\s*\"(?:curl|wget|nc|bash|sh)\""),
]
PROC_MACRO = r"proc[-_]macro\s*=\s*(?:true|\"true\"|'true')"

# --------------------------------------------------------------------------------------
# Evasion detectors
# --------------------------------------------------------------------------------------
EVASION_CATEGORIES = ["env_mutation", "time_bomb", "build_hooks", "derived_exfil", "direct_xpc", "anti_debug", "parser_partial_drift"]
ENV_MUTATION = (
    r"os\.environ\[['\"](SSH_AUTH_SOCK|LD_PRELOAD|LD_LIBRARY_PATH|PYTHONPATH|NODE_PATH|PATH|HOME|USER|HTTP_PROXY|"
    r"HTTPS_PROXY|NPM_TOKEN|GITHUB_TOKEN|AWS_ACCESS_KEY_ID|AWS_SECRET_ACCESS_KEY)['\"]\]\s*="
)
FUTURE_EPOCH = r"time\.time\(\)\s*[><]=?\s*(\d{10,})"
FUTURE_YEAR = r"datetime\.(?:now|utcnow)\(\)\s*[><]=?\s*datetime\(\s*(\d{4})"
LAST_PLAIN_YEAR = 2026
LIFECYCLE_KEYS = ["preinstall", "install", "postinstall", "prepublish", "prepare"]
SETUP_EXEC = r"(?:os\.system|subprocess\.(?:run|call|Popen|check_output))\s*\("
ENCODE_THEN_SEND = (
    r"(?:requests\.(?:post|put)|urllib\.|fetch\s*\(|http\.post).*?"
    r"(?:base64\.b64encode|zlib\.compress|binascii\.hexlify|\.hex\(\)|btoa\s*\()"
)
READ_THEN_ENCODE = r"open\s*\([^)]+\)\.read\s*\(\).*?base64\.b64encode"
BUNDLE_PATH_PARTS = [".map", ".wasm", "dist/", "build/", "node_modules/"]
XPC_TOKENS = (
    r"(xpc_connection_create|xpc_connection_create_mach_service|NSXPCConnection|CFMessagePortCreateRemote|"
    r"mach_port_allocate|mach_port_insert_right)"
)
DBUS_TOKENS = r"(dbus\.SessionBus\(\)|dbus\.SystemBus\(\)|org\.freedesktop\.|GDBusConnection|Gio\.DBus)"
ANTI_DEBUG = (
    r"(ptrace\s*\(|PTRACE_TRACEME|PTRACE_ATTACH|ctypes.*ptrace|IsDebuggerPresent|CheckRemoteDebuggerPresent|"
    r"/proc/self/status.*TracerPid|TracerPid\s*:\s*[^0])"
)
COLLAPSE_THRESHOLD = 5
# Literals (lower case) one of which every match of a detector contains; ours, like the rule anchors.
EVASION_ANCHORS = {
    "env_mutation": ["os.environ["],
    "future_epoch": ["time.time()"],
    "future_year": ["datetime."],
    "setup_exec": ["os.system", "subprocess."],
    "derived_exfil": ["b64encode", "zlib.compress", "hexlify", ".hex()", "btoa"],
    "xpc": ["xpc_", "nsxpc", "cfmessageport", "mach_port_"],
    "dbus": ["dbus", "org.freedesktop"],
    "anti_debug": ["ptrace", "debuggerpresent", "tracerpid"],
}

# --------------------------------------------------------------------------------------
# Package names
# --------------------------------------------------------------------------------------
TYPO_SIMILARITY = 0.85
POPULAR_TTL_DAYS = 7
POPULAR_NAMES = {
    "pypi": [
        "requests", "numpy", "pandas", "flask", "django", "boto3", "urllib3", "setuptools", "pip", "wheel", "pyyaml",
        "cryptography", "certifi", "click", "rich", "httpx", "pydantic", "fastapi", "sqlalchemy", "pytest", "black",
        "ruff", "mypy", "pillow", "scipy", "matplotlib", "torch", "tensorflow", "transformers", "openai", "anthropic",
        "litellm", "langchain", "crewai", "dspy", "pytorch-triton",
    ],
    "npm": [
        "express", "react", "vue", "angular", "next", "typescript", "lodash", "axios", "webpack", "babel", "eslint",
        "prettier", "jest", "mocha", "chalk", "commander", "inquirer", "debug", "moment", "dayjs", "cross-env",
    ],
    "crates": [
        "serde", "tokio", "rand", "clap", "reqwest", "hyper", "axum", "actix-web", "diesel", "sqlx", "tracing",
        "anyhow", "thiserror", "chrono", "regex", "log", "serde_json", "futures", "async-trait", "bytes", "once_cell",
        "lazy_static",
    ],
    "gem": [
        "rails", "rake", "bundler", "rspec", "puma", "sidekiq", "devise", "nokogiri", "pg", "redis", "sinatra",
        "rubocop", "capistrano", "rspec-rails", "factory_bot", "faker",
    ],
    "composer": [
        "laravel/framework", "symfony/console", "guzzlehttp/guzzle", "monolog/monolog", "phpunit/phpunit",
        "doctrine/orm", "league/flysystem", "twig/twig",
    ],
    "go": [
        "gin", "mux", "grpc", "echo", "fiber", "cobra", "viper", "zap", "logrus", "gorm", "sqlx", "testify", "wire",
        "fx",
    ],
    "nuget": [
        "Newtonsoft.Json", "Serilog", "AutoMapper", "MediatR", "Dapper", "FluentValidation", "Polly", "Moq", "xunit",
        "NUnit",
    ],
    "cocoapods": [
        "AFNetworking", "Alamofire", "SDWebImage", "SnapKit", "RxSwift", "RxCocoa", "Kingfisher", "Realm",
        "ReactiveCocoa", "Masonry", "FBSDKCoreKit", "Firebase", "FirebaseAnalytics", "FirebaseAuth", "GoogleSignIn",
        "Lottie", "MBProgressHUD", "SwiftLint", "Sentry", "Stripe",
    ],
    "jsr": [
        "@std/fs", "@std/path", "@std/http", "@std/encoding", "@std/async", "@std/log", "@std/uuid", "@std/json",
        "@std/yaml", "@std/text", "@std/datetime", "@std/cli", "@std/io", "@std/streams", "@std/testing", "@oak/oak",
        "@hono/hono",
    ],
}
ECOSYSTEM_ALIASES = {"cargo": "crates", "pods": "cocoapods"}
REPO_URL_KEYS = ["Repository", "Source", "Source Code", "GitHub", "Homepage"]

# --------------------------------------------------------------------------------------
# Reviewer votes
# --------------------------------------------------------------------------------------
MALICIOUS_SHARE = 0.6
SUSPICIOUS_SHARE = 0.5
CONTEXT_LIMITS = {"l1_quick": 4000, "l2_deep": 16000, "l3_expert": 64000}
CONTRADICTION_WORDS = [
    "credential theft", "data exfiltration", "exfiltrates", "backdoor", "reverse shell", "steal", "steals", "stealing",
    "keylogger", "cryptominer", "crypto mining", "cryptocurrency mining", "remote code execution", "command injection",
    "sends data to", "uploads sensitive", "reads ssh key", "reads credentials",
]
RECOMMENDATIONS = {
    "safe": "Package appears safe to install.",
    "suspicious": "Proceed with caution. Review the flagged risk signals manually.",
    "malicious": "DO NOT INSTALL. This package shows signs of malicious behavior.",
    "needs_human_review": "Models disagree. Manual review required before installation.",
}
CONTEXT_PRIORITY = ["setup.py", "setup.cfg", "pyproject.toml", "package.json", "postinstall", "preinstall", ".pth", "__init__.py"]

# --------------------------------------------------------------------------------------
# Evidence
# --------------------------------------------------------------------------------------
ADVISORY_ECOSYSTEMS = ["pypi", "npm", "pub"]

SOURCE_TTL_HOURS = {"context7": 168, "web_search": 24, "osv": 6, "deps_dev": 24, "scorecard": 24, "provenance": 24}
VERDICT_TTL_HOURS = 72
HIGH_MENTION_WORDS = [
    "malicious", "malware", "supply chain attack", "backdoor", "compromised", "hijacked", "trojan", "credential theft",
    "data exfiltration", "cryptominer",
]
MEDIUM_MENTION_WORDS = ["vulnerability", "cve-", "ghsa-", "security advisory", "deprecated", "abandoned", "unmaintained"]
LOW_MENTION_WORDS = ["security", "risk", "warning", "caution"]
CAPABILITIES = [
    ("http", "HTTP requests"), ("websocket", "WebSocket connections"), ("database", "database operations"),
    ("file system", "file system access"), ("authentication", "authentication"), ("encryption", "encryption/cryptography"),
    ("parsing", "data parsing"), ("cli", "command-line interface"), ("testing", "testing utilities"),
    ("logging", "logging"), ("caching", "caching"), ("orm", "ORM / database mapping"), ("template", "templating"),
    ("routing", "URL routing"), ("middleware", "middleware"), ("serialization", "data serialization"),
]

# --------------------------------------------------------------------------------------
# Agent-facing text
# --------------------------------------------------------------------------------------
SUSPICIOUS_TEXT = [
    ("reverse shell reference", "reverse", r"reverse.?shell"),
    ("netcat listener", "nc", r"nc\s+-[elp]"),
    ("eval/exec chain", "eval", r"\beval\b.*\bexec\b"),
    ("curl piped to shell", "curl", r"curl.*\|\s*(?:ba|z)?sh"),
    ("wget piped to shell", "wget", r"wget.*\|\s*(?:ba|z)?sh"),
    ("SSH directory access", ".ssh/", r"\.ssh/"),
    ("AWS credentials access", ".aws/", r"\.aws/"),
    (".env file access", ".env", r"\.env\b"),
    ("prompt injection attempt", "ignore", r"ignore\s+(?:all\s+)?previous\s+instructions"),
    ("hardcoded credential reference", "hardcode", r"(?:always|must|should)\s+hardcode"),
    ("raw IP URL (potential C2)", "http://", r"http://\d+\.\d+\.\d+\.\d+"),
]
HIDDEN_UNICODE = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\ufeff"
BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"

# --------------------------------------------------------------------------------------
# Install commands
# --------------------------------------------------------------------------------------
SYSTEM_PACKAGES = ["pip", "setuptools", "wheel", "pkg-resources", "distribute"]
VALUE_FLAGS = [
    "-r", "--requirement", "-c", "--constraint", "-e", "--editable", "-i", "--index-url", "--extra-index-url",
    "--find-links", "-f", "--target", "-t", "--prefix", "--root", "--src", "--registry", "-w", "--workspace", "--tag",
]
CARGO_VALUE_FLAGS = ["--git", "--path", "--registry", "--version", "--branch", "--tag", "--rev", "--features", "-F", "--rename"]
GEM_VALUE_FLAGS = ["--version", "-v", "--source", "--platform", "--group", "-g"]
DOTNET_VALUE_FLAGS = ["--version", "-v", "--source", "--framework", "-f"]
DOCKER_VALUE_FLAGS = [
    "-p", "--publish", "-e", "--env", "--name", "--network", "--net", "-v", "--volume", "-w", "--workdir",
    "--entrypoint", "--user", "-u", "--hostname", "-h", "--memory", "-m", "--cpus", "--restart", "--mount", "--label",
    "-l", "--env-file", "--log-driver",
]
TRUSTED_REGISTRIES = ["gcr.io/", "ghcr.io/", "docker.io/library/", "mcr.microsoft.com/"]

# --------------------------------------------------------------------------------------
# Sandbox traces
# --------------------------------------------------------------------------------------
SYNTHETIC_SOURCES = ["resource_probe", "observer_canary"]
DECOY_PATHS = [
    "~/.ssh/id_rsa", "~/.ssh/id_ed25519", "~/.aws/credentials", "~/.npmrc", "~/.pypirc", "~/.docker/config.json",
    "~/.gitconfig", "~/.netrc", "~/.config/gh/hosts.yml", "/etc/shadow",
]
DECOY_AUTOSTART_DIRS = ["~/.config/autostart", "~/Library/LaunchAgents", "/etc/cron.d", "~/.config/systemd/user"]
WRITE_FLAGS = ["O_WRONLY", "O_RDWR", "O_CREAT", "O_TRUNC", "O_APPEND"]
LIGHT_TIER_FLOOR = ["syscall_trace", "process_tree", "env_reads"]
FLOOR_MIN_KINDS = 3
NETWORK_KINDS = ["connect", "dns"]
WRITE_KINDS = ["write", "persist_write"]
FLOOR_MIN_EVENTS = 10
FLOOR_MIN_DURATION_MS = 2000
PARSE_RATIO_FLOOR = 0.5
STUCK_SECONDS = 10
STUCK_SECONDS_RANGE = (2, 60)
DRIFT_SECONDS = 5
LONG_SLEEP_SECONDS = 30


# --------------------------------------------------------------------------------------
# Lines of system-call traces
# --------------------------------------------------------------------------------------
# Patterns.
TRACE_PID = r"^\s*(?:\[pid\s+(\d+)\]|(\d+))\s+"
TRACE_CALL = r"^(\w+)\((.*)\)\s*=\s*(.+)$"
TRACE_UNFINISHED = r"^(\w+)\((.*?)\s*<unfinished\s*\.+\s*>$"
TRACE_RESUMED = r"^<\.\.\.\s+(\w+)\s+resumed>\s*(.*)"
TRACE_INET4 = r'sa_family=AF_INET[^,}]*,\s*sin_port=htons\((\d+)\),\s*sin_addr=inet_addr\("([^"]+)"\)'
TRACE_INET6 = r"sa_family=AF_INET6[^,}]*,\s*sin6_port=htons\((\d+)\)"
TRACE_UNIX = r'sa_family=AF_UNIX,\s*sun_path="([^"]+)"'
TRACE_OPENAT = r'(?:AT_FDCWD|-?\d+),\s*"([^"]+)"(?:,\s*([A-Z_0-9|]+))?'
TRACE_QUOTED = r'"([^"\\]*(?:\\.[^"\\]*)*)"'


# --------------------------------------------------------------------------------------
# Install commands
# --------------------------------------------------------------------------------------
# Patterns.
COMMAND_LEAD = r"(?:^|[;\s&|]+)"
COMMAND_ARGS = r"(?:\s+(.*))?$"
COMMAND_PIP = COMMAND_LEAD + r"(?:pip3?|python3?\s+-m\s+pip|uv\s+pip)\s+install" + COMMAND_ARGS
COMMAND_NPM = COMMAND_LEAD + r"(npm|yarn|pnpm)\s+(install|i|add)" + COMMAND_ARGS
COMMAND_FVM = COMMAND_LEAD + r"fvm\s+install"
COMMAND_DART = COMMAND_LEAD + r"(?:dart|flutter)\s+pub\s+(add|get)" + COMMAND_ARGS
COMMAND_POD = COMMAND_LEAD + r"pod\s+(?:install|update)(?:\s|$)"
COMMAND_CARGO = COMMAND_LEAD + r"cargo\s+(?:add|install)" + COMMAND_ARGS
COMMAND_GEM = COMMAND_LEAD + r"(?:gem\s+install|bundle\s+(?:add|install))" + COMMAND_ARGS
COMMAND_COMPOSER = COMMAND_LEAD + r"composer\s+(require|install)" + COMMAND_ARGS
COMMAND_GO = COMMAND_LEAD + r"go\s+(?:get|install)" + COMMAND_ARGS
COMMAND_DOTNET = COMMAND_LEAD + r"dotnet\s+add\s+(?:\S+\s+)?package" + COMMAND_ARGS
COMMAND_MANAGERS = [COMMAND_PIP, COMMAND_NPM, COMMAND_FVM, COMMAND_DART, COMMAND_POD, COMMAND_CARGO, COMMAND_GEM, COMMAND_COMPOSER, COMMAND_GO, COMMAND_DOTNET]
COMMAND_PIPED = r"(?:curl|wget)\s+[^|]+\|\s*(?:sudo\s+)?(?:ba|z)?sh"
COMMAND_FETCHED = r"(?:curl|wget)\s+(?:-[^\s]*\s+)*(\S+)"
COMMAND_DOCKER = COMMAND_LEAD + r"docker\s+(?:pull|run)\s+(.*?)$"
COMMAND_EXTENSION = r"code\s+--install-extension\s+(\S+)"

# Fixed value: a pod of a lock file.
POD_LINE = r"^([^\s()]+)\s*\(\s*=?\s*([^\s()]+)\s*\)\s*$"
