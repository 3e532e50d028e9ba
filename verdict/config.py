"""The settings a run is described by, as a plain object.

Nothing here touches data. The small dimension tables every operator needs
(languages, directions, methods, the model panel) are derived from a
``Settings`` value by :mod:`verdict.dimensions`, and their size is bounded by
the settings, never by the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Model:
    """One model of the panel."""

    id: str
    runtime: str
    access: str = "local"
    weights: str = "open"
    precision: str = "full"
    url: str = ""
    # 'provider' means the model decodes as it likes: no temperature / top_p
    # is sent.
    sampling: str = ""
    reasoning_headroom: int = 0

    @property
    def takes_sampling(self) -> bool:
        return self.sampling.lower() != "provider"


@dataclass(frozen=True)
class Method:
    """One way of asking; ``shots`` may list several example counts."""

    name: str
    title: str
    max_tokens: int
    shots: tuple[int, ...] = (0,)


# ---------------------------------------------------------------------------
# Fixed values. These must equal the evaluated pipeline's configuration for the
# results to be comparable; they are listed as written there.
# ---------------------------------------------------------------------------
POSITIVE_LABEL = "Hallucination"
NEGATIVE_LABEL = "No hallucination"
NEGATIVE_GRADE = "1_No_hallucination"
POSITIVE_GRADES = (
    "2_Small_hallucination",
    "3_Partial_hallucination",
    "4_Full_hallucination",
)
DEFAULT_LANGUAGES = (
    ("arb_Arab", "Arabic"),
    ("deu_Latn", "German"),
    ("spa_Latn", "Spanish"),
    ("rus_Cyrl", "Russian"),
    ("zho_Hans", "Chinese"),
    ("yor_Latn", "Yoruba"),
    ("mni_Beng", "Manipuri"),
    ("kas_Deva", "Kashmiri"),
)
DEFAULT_ANCHOR = ("eng_Latn", "English")
DEFAULT_EXTRA_PAIRS = (("spa_Latn", "yor_Latn"), ("yor_Latn", "spa_Latn"))
DEFAULT_METHODS = (
    Method("baseline", "Zero Shot Binary", 48, (0,)),
    Method("fewshot", "Few Shot", 48, (1, 2, 3)),
    Method("translate", "Chain of Translation", 384, (0,)),
    Method("span", "Span Level Chain of Thought", 512, (0,)),
    Method("debate", "Multi Agent Review", 384, (0,)),
)
DEFAULT_MODELS = (
    Model("mlx-community/Meta-Llama-3-8B-Instruct-4bit", "mlx", precision="4-bit"),
    Model("mlx-community/Qwen2.5-7B-Instruct-4bit", "mlx", precision="4-bit"),
    Model("deepseek-v4-flash", "api", access="api", sampling="provider",
          reasoning_headroom=640),
)
DEFAULT_SEED = 20260816
# The method whose prompts are built only once a first round exists.
REVIEW_METHOD = "debate"


@dataclass(frozen=True)
class Settings:
    languages: tuple[tuple[str, str], ...] = DEFAULT_LANGUAGES
    anchor: tuple[str, str] = DEFAULT_ANCHOR
    extra_pairs: tuple[tuple[str, str], ...] = DEFAULT_EXTRA_PAIRS
    methods: tuple[Method, ...] = DEFAULT_METHODS
    models: tuple[Model, ...] = DEFAULT_MODELS
    positive_label: str = POSITIVE_LABEL
    negative_label: str = NEGATIVE_LABEL
    positive_grades: tuple[str, ...] = POSITIVE_GRADES
    negative_grade: str = NEGATIVE_GRADE
    replicates: int = 3
    temperature: float = 1.0
    top_p: float = 1.0
    items_per_direction: int = 40
    sample_seed: int = DEFAULT_SEED
    example_seed: int = DEFAULT_SEED
    refusal_threshold: float = 0.5
    review_method: str = REVIEW_METHOD
    extra: dict = field(default_factory=dict)

    # -- derived, all bounded by the settings themselves -------------------
    def language_names(self) -> dict[str, str]:
        return {**dict(self.languages), self.anchor[0]: self.anchor[1]}

    def directions(self) -> list[tuple[str, str]]:
        """Every language against the anchor both ways, then the extra pairs."""
        found = []
        for code, _ in self.languages:
            found.append((code, self.anchor[0]))
            found.append((self.anchor[0], code))
        found.extend(tuple(p) for p in self.extra_pairs)
        return found

    def method(self, name: str) -> Method:
        for m in self.methods:
            if m.name == name:
                return m
        raise KeyError(name)

    def prompt_methods(self) -> list[tuple[str, int]]:
        """(method, shots) pairs built ahead of generation, review excluded."""
        return [(m.name, s) for m in self.methods
                if m.name != self.review_method for s in m.shots]

    def model(self, model_id: str) -> Model:
        for m in self.models:
            if m.id == model_id:
                return m
        raise KeyError(model_id)

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULT = Settings()

# The panel and languages of the derived test fixture (FIXTURES.md §3): the
# driver's documents carry en/fr/de/es, and two invented model ids.
FIXTURE = Settings(
    languages=(("de", "German"), ("es", "Spanish"), ("fr", "French")),
    anchor=("en", "English"),
    extra_pairs=(("es", "fr"), ("fr", "es")),
    models=(
        Model("org/alpha", "mlx", precision="4-bit"),
        Model("org/beta", "api", access="api", sampling="provider",
              reasoning_headroom=640),
    ),
)
