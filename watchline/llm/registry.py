"""What the entry module takes over from this subpackage."""

from watchline.llm.queries import REGISTRY

__all__ = ["REGISTRY"]
