"""Install commands: which packages a shell command would install, and risky ways to install.

Commands are parsed row by row with built-in functions only, so the same code judges a command
log and a stream of commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P

OPT_OUT = "--no-check"
REQUEST = "struct<mode:string,ecosystem:string,targets:array<string>>"


def words(args: Column) -> Column:
    return F.filter(F.split(P.strip(args), r"(?U)\s+"), lambda t: t != "")


def without_values(args: Column, flags: list[str]) -> Column:
    """Arguments without the flags that take a value and without that value.

    Replacing from left to right consumes a flag together with whatever follows it, so a flag
    that is itself the value of another one takes nothing.
    """
    names = "|".join(f.replace(".", r"\.") for f in flags)
    return F.regexp_replace(args, rf"(?U)(?:^|(?<=\s))(?:{names})(?=\s|$)(?:\s+\S+)?", "")


def plain_words(args: Column, flags: list[str] | None = None) -> Column:
    rest = without_values(args, flags) if flags else args
    return F.filter(words(rest), lambda t: ~t.startswith("-"))


def is_local(token: Column) -> Column:
    return token.isin(".", "./") | P.starts_with_any(token, ["./", "/", "../"])


def request(mode: str, ecosystem: str, targets: Column) -> Column:
    return F.struct(F.lit(mode).alias("mode"), F.lit(ecosystem).alias("ecosystem"), targets.alias("targets")).cast(REQUEST)


def check(ecosystem: str, packages: Column) -> Column:
    return F.when(F.size(packages) > 0, request("check", ecosystem, packages))


def scan(ecosystem: str, lockfile: Column | str) -> Column:
    return request("scan", ecosystem, F.array(F.lit(lockfile) if isinstance(lockfile, str) else lockfile))


def pip_request(args: Column, opt_out: str) -> Column:
    tokens = words(args)
    manifest = F.regexp_extract(args, r"(?U)(?:^|\s)(?:-r|--requirement)\s+(\S+)", 1)
    bare = F.filter(tokens, lambda t: ~t.startswith("-"))
    only_local = (F.size(bare) > 0) & F.forall(bare, is_local)
    remote = F.filter(plain_words(args, V.VALUE_FLAGS), lambda t: ~is_local(t) & ~t.contains("://"))
    names = F.filter(
        F.transform(remote, lambda t: F.split(t, "[=<>!~@]", 2)[0]), lambda n: (n != "") & ~F.lower(n).isin(V.SYSTEM_PACKAGES)
    )
    return F.when(
        ~F.array_contains(tokens, opt_out),
        F.when(manifest != "", scan("pypi", manifest)).when(~only_local, check("pypi", names)),
    )


def npm_request(manager: Column, args: Column, opt_out: str) -> Column:
    def name(t: Column) -> Column:
        scoped = F.regexp_extract(t, "^(@[^/]+/[^@]+)", 1)
        return F.when(t.startswith("@") & t.contains("/"), F.when(scoped != "", scoped).otherwise(t)).otherwise(
            F.substring_index(t, "@", 1)
        )

    names = F.filter(
        F.transform(plain_words(args, V.VALUE_FLAGS), name), lambda n: (n != "") & (~n.contains("/") | n.startswith("@"))
    )
    lockfile = F.when(manager == "yarn", "yarn.lock").when(manager == "pnpm", "pnpm-lock.yaml").otherwise("package-lock.json")
    return F.when(~F.array_contains(words(args), opt_out), F.coalesce(check("npm", names), scan("npm", lockfile)))


def install_request(command: Column, opt_out: str = OPT_OUT) -> Column:
    """What a command would install: packages to check or a lock file to scan, null for neither.

    A lock file is named whether or not it exists: its owner decides that.  The first package
    manager that matches decides, in a fixed order.
    """
    hit = lambda pattern: P.found(command, pattern)
    part = lambda pattern, n: P.first(command, pattern, n)
    dart_args, composer_args = part(V.COMMAND_DART, 2), part(V.COMMAND_COMPOSER, 2)
    gems = check("gem", plain_words(part(V.COMMAND_GEM, 1), V.GEM_VALUE_FLAGS))
    modules = F.filter(F.transform(plain_words(part(V.COMMAND_GO, 1)), lambda t: F.substring_index(t, "@", 1)), lambda n: n != "")
    nothing = F.lit(None).cast(REQUEST)
    return (
        F.when(hit(V.COMMAND_PIP), pip_request(part(V.COMMAND_PIP, 1), opt_out))
        .when(hit(V.COMMAND_NPM), npm_request(part(V.COMMAND_NPM, 1), part(V.COMMAND_NPM, 3), opt_out))
        .when(hit(V.COMMAND_FVM), nothing)
        .when(
            hit(V.COMMAND_DART),
            F.when((part(V.COMMAND_DART, 1) == "add") & (P.strip(dart_args) != ""), check("pub", plain_words(dart_args))).otherwise(
                scan("pub", "pubspec.lock")
            ),
        )
        .when(hit(V.COMMAND_POD), scan("cocoapods", "Podfile.lock"))
        .when(hit(V.COMMAND_CARGO), check("cargo", plain_words(part(V.COMMAND_CARGO, 1), V.CARGO_VALUE_FLAGS)))
        .when(hit(V.COMMAND_GEM), F.coalesce(gems, F.when(command.contains("bundle install"), scan("gem", "Gemfile.lock"))))
        .when(
            hit(V.COMMAND_COMPOSER),
            F.when(part(V.COMMAND_COMPOSER, 1) == "install", scan("composer", "composer.lock")).otherwise(
                check("composer", plain_words(composer_args))
            ),
        )
        .when(hit(V.COMMAND_GO), check("go", modules))
        .when(hit(V.COMMAND_DOTNET), check("nuget", plain_words(part(V.COMMAND_DOTNET, 1), V.DOTNET_VALUE_FLAGS)))
    )


def install_commands(commands: DataFrame, opt_out: str = OPT_OUT) -> DataFrame:
    """One row per package or lock file of every install command."""
    asked = F.filter(F.array(install_request(F.col("command"), opt_out)), lambda r: r.isNotNull())
    requests = commands.select("event_id", F.explode(asked).alias("_r"))
    return requests.select("event_id", "_r.mode", "_r.ecosystem", F.explode("_r.targets").alias("target"))


def risk_warning(command: Column) -> Column:
    """Risky installs outside package managers: (risk, reason) or null."""
    managed = P.any_of([P.found(command, p) for p in V.COMMAND_MANAGERS])
    url = P.first(command, V.COMMAND_FETCHED)
    shown = F.when((url == "") | url.startswith("-"), "unknown").otherwise(url)
    image = F.get(plain_words(P.first(command, V.COMMAND_DOCKER), V.DOCKER_VALUE_FLAGS), 0)
    foreign = F.substring_index(image, ":", 1).contains("/") & ~P.starts_with_any(image, V.TRUSTED_REGISTRIES)
    warn = lambda risk, reason: F.struct(F.lit(risk).alias("risk"), reason.alias("reason"))
    return F.when(
        ~managed,
        F.when(P.found(command, V.COMMAND_PIPED), warn("HIGH", F.concat(F.lit("Piping remote script to shell: "), shown)))
        .when(P.found(command, V.COMMAND_DOCKER) & foreign, warn("MEDIUM", F.concat(F.lit("Untrusted Docker image: "), image)))
        .when(
            P.found(command, V.COMMAND_EXTENSION),
            warn("MEDIUM", F.concat(F.lit("VSCode extension install: "), P.first(command, V.COMMAND_EXTENSION))),
        ),
    )


def risky_commands(commands: DataFrame) -> DataFrame:
    found = F.filter(F.array(risk_warning(F.col("command"))), lambda w: w.isNotNull())
    return commands.select("event_id", F.explode(found).alias("_w")).select("event_id", "_w.risk", "_w.reason")


def judged_commands(commands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every checked package with ``block`` or ``allow`` from the verdict table.

    ``verdicts``: ``ecosystem, name, should_block_install``, one row per package; works on a
    stream of commands, the table then is the static side.
    """
    checks = install_commands(commands).filter("mode = 'check'").withColumnRenamed("target", "name")
    joined = checks.join(verdicts.select("ecosystem", "name", "should_block_install"), ["ecosystem", "name"], "left")
    return joined.select(
        "event_id", "ecosystem", "name",
        F.when(F.coalesce("should_block_install", F.lit(False)), "block").otherwise("allow").alias("decision"),
    )
