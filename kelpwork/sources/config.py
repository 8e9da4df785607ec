"""Settings of a pipeline run."""

from __future__ import annotations

from pathlib import Path


class Settings(dict):
    """A configuration as nested mappings, and where its outputs go."""

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        """A YAML file; raises unless it holds a mapping."""
        import yaml

        held = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        if not isinstance(held, dict):
            raise ValueError(f"{path} holds no mapping")
        return cls(held)

    def target(self, path: str) -> str:
        """Absolute paths and those with a scheme as they are, others below ``output_dir`` (default: the working folder)."""
        if path.startswith("/") or "://" in path:
            return path
        return f"{str(self.get('output_dir', '.')).rstrip('/')}/{path}"
