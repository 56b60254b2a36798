"""Settings, with the defaults every operator falls back to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from commentloom.functions import wordlists

DEFAULT_QUESTIONS = tuple(f"Q4.{i}" for i in range(2, 11))


@dataclass(frozen=True)
class InputSettings:
    comment_cols: tuple[str, ...] = DEFAULT_QUESTIONS
    drop_label_rows: bool = False
    label_rows: int = 2


@dataclass(frozen=True)
class TranslationSettings:
    min_comment_length: int = 10
    max_allowed_issues: int = 2
    batch_size: int = 100
    target: str = "en"


@dataclass(frozen=True)
class EmbeddingSettings:
    """Model name and time-out belong to the provider that is plugged in."""

    batch_size: int = 128
    expected_dim: int = 768


@dataclass(frozen=True)
class RetrySettings:
    max_attempts: int = 3
    wait: float = 2.0
    # Calls that may run at the same time.
    max_parallel_calls: int = 64


@dataclass(frozen=True)
class ClusteringSettings:
    min_docs: int = 5
    min_pts: int = 5
    pca_dims: int = 50
    max_kmeans_k: int = 10
    n_start: int = 10
    seed: int = 42
    n_neighbors: int = 15
    layout_epochs: int = 200
    # Rows that one task of the layout moves, and how often the tasks of a larger question exchange positions.
    layout_rows: int = 4096
    layout_exchanges: int = 8
    # Questions (or their translated columns) that get vectors; all if empty.
    embedding_columns: tuple[str, ...] = ()
    # Rows handled by one task of a distance job, and pivots per question.
    block_rows: int = 2048
    # The same for neighbours and silhouettes, whose tasks go through a block in pieces: a row is
    # copied once for each partner block, so larger blocks mean fewer copies.
    pair_rows: int = 16_384
    max_pivots: int = 256
    # Largest tree (edges of one question) that a single task may finish.
    tree_limit: int = 1_000_000


@dataclass(frozen=True)
class TermSettings:
    max_words: int = 800
    min_freq: int = 1
    weight_power: float = 1.2
    rotate_ratio: float = 0.3
    # What decides between terms of one frequency: "term" or "first_seen".
    ties: str = "term"
    question_ids: tuple[int, ...] = (2, 10)
    stop_words: tuple[str, ...] = wordlists.ENGLISH_STOP_WORDS + ("will",)
    custom_stop_words: tuple[str, ...] = wordlists.CUSTOM_STOP_WORDS
    regex_stop_words: tuple[str, ...] = wordlists.REGEX_STOP_WORDS
    question_stop_words: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(wordlists.QUESTION_STOP_WORDS)
    )
    palette: tuple[str, ...] = wordlists.DARK_PALETTE
    # "random-dark" cycles the palette; any other value is one colour for all terms.
    color: str = "random-dark"


@dataclass(frozen=True)
class Settings:
    input: InputSettings = field(default_factory=InputSettings)
    translation: TranslationSettings = field(default_factory=TranslationSettings)
    embeddings: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    retry: RetrySettings = field(default_factory=RetrySettings)
    clustering: ClusteringSettings = field(default_factory=ClusteringSettings)
    terms: TermSettings = field(default_factory=TermSettings)

    @staticmethod
    def from_mapping(values: Mapping[str, Any]) -> Settings:
        """Override defaults from a nested mapping such as a parsed YAML file.

        Sections and keys that no operator reads (paths, credentials, drawing
        sizes) are ignored. `visualization`, `q_range`, `umap_dims` and the
        other names used by existing configuration files are accepted.
        """
        sections = dict(values)
        sections["terms"] = {**sections.pop("visualization", {}), **sections.get("terms", {})}
        if "question_stopwords" in sections:
            sections["terms"]["question_stop_words"] = {
                key.removesuffix("_translated"): words
                for key, words in sections.pop("question_stopwords").items()
            }
        if "drop_label_rows" in sections.get("translation", {}):
            sections["input"] = {
                **sections.get("input", {}),
                "drop_label_rows": sections["translation"]["drop_label_rows"],
            }
        result = Settings()
        for part in fields(Settings):
            current = getattr(result, part.name)
            known = {f.name for f in fields(current)}
            given = {_ALIASES.get(k, k): _freeze(v) for k, v in (sections.get(part.name) or {}).items()}
            chosen = {k: v for k, v in given.items() if k in known}
            result = replace(result, **{part.name: replace(current, **chosen)})
        return result


_ALIASES = {
    "q_range": "question_ids",
    "umap_dims": "pca_dims",
    "rotateRatio": "rotate_ratio",
    "custom_stopwords": "custom_stop_words",
    "regex_stopwords": "regex_stop_words",
}


def _freeze(value: Any) -> Any:
    if isinstance(value, list):
        return tuple(value)
    if isinstance(value, Mapping):
        return {k: _freeze(v) for k, v in value.items()}
    return value
