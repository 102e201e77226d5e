"""Which files of a repository are sources worth sampling. The tables are parameters: pass others to change them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings by language.
EXTENSIONS = {
    "python": (".py",), "java": (".java",), "cpp": (".h", ".cpp"), "javascript": (".js", ".jsx"), "typescript": (".ts", ".tsx"), "c_sharp": (".cs",), "php": (".php",), "go": (".go",), "c": (".c",), "rust": (".rs",),
    "r": (".R", ".r"), "ruby": (".rb",), "scala": (".scala",), "kotlin": (".kt", ".kts"), "perl": (".pl", ".pm"), "swift": (".swift",), "zig": (".zig",), "verilog": (".v", ".vh", ".sv", ".svh"), "lua": (".lua",), "html": (".html", ".htm"),
}
#: Path parts that no sources but those of python are denied by; python has a list of its own.
COMMON = ("test/", "tests/", "docs/", "documentation/", "examples/", "sample/", "demo/", "benchmark/")
#: Path parts that a language's sources are denied by besides, a tuple for each language.
PYTHON = ("test/", "tests/", "docs/", "build/", "evaluate_repo.py", "setup.py")
JAVA = ("target/", "build/", ".gradle/", "gradle/", "pom.xml", "build.gradle", "settings.gradle", "gradlew", ".mvn/", "mvnw")
CPP = (
    "build/", "cmake-build-", "CMakeFiles/", "CMakeCache.txt", "Makefile", "third_party/", "external/", "vendor/", "CMakeLists.txt",
    ".cmake", "configure", "autogen", ".o", ".so", ".a", ".exe", ".dll",
)
C = (*CPP, "config.h", "version.h")
JAVASCRIPT = (
    "node_modules/", "build/", "dist/", ".next/", "coverage/", "public/", "static/", "assets/", "package.json", "package-lock.json",
    "yarn.lock", "webpack.config.js", ".babelrc", "tsconfig.json", ".eslintrc", ".gitignore", "README.md", ".env",
)
TYPESCRIPT = (*JAVASCRIPT, "jest.config.js", "rollup.config.js", "vite.config.ts")
C_SHARP = (
    "bin/", "obj/", "packages/", ".vs/", "Debug/", "Release/", ".csproj", ".sln", ".config", "AssemblyInfo.cs", ".nuspec", ".nupkg",
    "nuget.exe", ".dll", ".exe", ".pdb",
)
PHP = (
    "vendor/", "build/", "dist/", "cache/", "storage/", "logs/", "public/", "assets/", "resources/", "composer.json", "composer.lock",
    "package.json", ".env", ".htaccess", "phpunit.xml", "webpack.mix.js", "artisan", "server.php", "bootstrap/", "config/", "database/",
    ".phpunit.result.cache", ".gitignore", "README.md",
)
GO = (
    "vendor/", "build/", "bin/", "pkg/", ".git/", "testdata/", "_test.go", "go.mod", "go.sum", "Makefile", "Dockerfile", ".env",
    "README.md", ".gitignore", "LICENSE", "CHANGELOG", "scripts/", "tools/", "hack/", ".github/", "deployments/", "configs/",
)
RUST = (
    "target/", "build/", "deps/", ".cargo/", "vendor/", "benches/", "fixtures/", "testdata/", "Cargo.toml", "Cargo.lock", "build.rs",
    ".gitignore", "README.md", "LICENSE", "CHANGELOG", ".github/", "scripts/", "tools/", "ci/", "docker/",
)
R = (
    "build/", "dist/", "vignettes/", "inst/", "man/", "data/", "data-raw/", ".Rproj", "DESCRIPTION", "NAMESPACE", "NEWS", ".Rhistory",
    ".RData", ".Ruserdata", "packrat/", "renv/", ".gitignore", "README.md", "LICENSE", "CHANGELOG",
)
RUBY = (
    "spec/", "build/", "tmp/", "log/", "vendor/", "bundle/", "coverage/", ".bundle/", "node_modules/", "Gemfile", "Rakefile", ".gemspec",
    "config.ru", ".rspec", ".rubocop.yml", ".gitignore", "README.md", "LICENSE", "CHANGELOG", ".env", "db/migrate/", "public/", "assets/",
)
SCALA = (
    "target/", "build/", "project/", ".bloop/", ".metals/", "build.sbt", "build.sc", ".gitignore", "README.md", "LICENSE", "CHANGELOG",
    ".github/", "scripts/", "conf/", "resources/", ".scalafmt.conf", "metals.sbt", ".scalafix.conf",
)
KOTLIN = ("build/", "target/", ".gradle/", "gradle/", "build.gradle", "settings.gradle", "gradlew", ".idea/", ".gitignore", "README.md", "LICENSE", "kapt/")
PERL = ("build/", ".t", "Makefile.PL", "Build.PL", ".gitignore", "README.md", "LICENSE")
SWIFT = (
    "build/", ".build/", "DerivedData/", "Pods/", "Carthage/", "fastlane/", ".swiftpm/", "xcuserdata/", "Package.swift", "project.pbxproj",
    ".xcworkspace", ".xcodeproj", "Podfile", "Cartfile", ".gitignore", "README.md", "LICENSE", "CHANGELOG", ".github/", "scripts/",
    "tools/", "ci/", "docker/", "Tests/", "TestPlans/", "UITests/",
)
ZIG = (
    "zig-cache/", "zig-out/", "build/", ".zig-cache/", "target/", "vendor/", "deps/", "build.zig", ".gitignore", "README.md", "LICENSE",
    "CHANGELOG", ".github/", "scripts/", "tools/", "ci/", "docker/", "gyro.zzz", "zigmod.yml", "zigmod.lock",
)
VERILOG = (
    "tb/", "testbench/", "sim/", "simulation/", "build/", "work/", "modelsim/", "vivado/", "quartus/", "synopsys/", "cadence/", "scripts/",
    "tools/", "utils/", ".gitignore", "README.md", "LICENSE", "CHANGELOG", ".github/", "Makefile", "*.do", "*.tcl", "*.sdc", "*.xdc",
    "*.ucf", "*.qsf", "_tb.", "_test.", "testbench_",
)
LUA = (
    "spec/", "build/", "dist/", "out/", "target/", "vendor/", "rocks/", ".luarocks/", "rockspec", "Makefile", "makefile", ".gitignore",
    "README.md", "LICENSE", "CHANGELOG", ".github/", "scripts/", "tools/", "ci/", "docker/", "config/", "conf/", ".env", "_test.lua",
    "test_", "spec_",
)
HTML = (
    "spec/", "build/", "dist/", "out/", "target/", "vendor/", "node_modules/", "bower_components/", "assets/", "static/", "public/",
    ".gitignore", "README.md", "LICENSE", "CHANGELOG", ".github/", "scripts/", "tools/", "ci/", "docker/", "config/", "conf/", ".env",
    "package.json", "webpack.config", "gulpfile", "gruntfile", "_test.html", "test_", "spec_",
)
#: What each language is denied by; a language without an entry is denied by nothing but has no endings either.
DENIED = {
    "python": PYTHON, "java": (*COMMON, *JAVA), "cpp": (*COMMON, *CPP), "c": (*COMMON, *C), "javascript": (*COMMON, *JAVASCRIPT),
    "typescript": (*COMMON, *TYPESCRIPT), "c_sharp": (*COMMON, *C_SHARP), "php": (*COMMON, *PHP), "go": (*COMMON, *GO), "rust": (*COMMON, *RUST),
    "r": (*COMMON, *R), "ruby": (*COMMON, *RUBY), "scala": (*COMMON, *SCALA), "kotlin": (*COMMON, *KOTLIN), "perl": (*COMMON, *PERL),
    "swift": (*COMMON, *SWIFT), "zig": (*COMMON, *ZIG), "verilog": (*COMMON, *VERILOG), "lua": (*COMMON, *LUA), "html": (*COMMON, *HTML),
}
#: Pairs of parts that deny a path together, and a part that denies unless another one is there.
TOGETHER = {"zig": ("lib/", "test"), "lua": ("lib/", "test")}
UNLESS = {"typescript": (".d.ts", "index.d.ts")}
#: Languages whose files must not begin with a dot.
NO_DOT_FILES = ("javascript", "typescript")


def denied(language: str, extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Path parts that a language's sources must not contain; extra: more of them."""
    return (*DENIED.get(language, ()), *extra)


def is_source(path: Column, language: str, extra: tuple[str, ...] = ()) -> Column:
    """By the repository-relative path alone; false for languages without a table."""
    if language not in EXTENSIONS:
        return F.lit(False)
    has = lambda part: F.contains(path, F.lit(part))
    rejected = F.lit(False)
    for part in denied(language, extra):
        rejected = rejected | has(part)
    if language in TOGETHER:
        one, other = TOGETHER[language]
        rejected = rejected | (has(one) & has(other))
    if language in UNLESS:
        one, other = UNLESS[language]
        rejected = rejected | (has(one) & ~has(other))
    if language in NO_DOT_FILES:
        rejected = rejected | F.startswith(F.substring_index(path, "/", -1), F.lit("."))
    return has_ending(path, language) & ~rejected


def is_source_by(path: Column, language: Column, extra: tuple[str, ...] = ()) -> Column:
    """The same with the language in a column; false for unknown languages and null."""
    out = F.lit(False)
    for name in EXTENSIONS:
        out = F.when(language == name, is_source(path, name, extra)).otherwise(out)
    return out


def has_ending(path: Column, language: str) -> Column:
    ending = F.lit(False)
    for e in EXTENSIONS.get(language, ()):
        ending = ending | F.endswith(path, F.lit(e))
    return ending


#: Languages that are evaluated, levels, and pairs that make no sense.
LANGUAGES = ("c", "c_sharp", "cpp", "go", "html", "java", "javascript", "kotlin", "lua", "php", "python", "r", "rust", "scala", "swift", "typescript", "verilog", "zig")
LEVELS = ("class", "function", "block", "line")
EXCLUDED = (("html", "class"), ("html", "function"), ("c", "class"), ("go", "class"))


def ratios(level: str) -> dict[str, float]:
    """How often each grain is drawn for a task level: its own always and no other; an unknown level draws none."""
    return {grain: float(grain == level.lower()) for grain in LEVELS}
