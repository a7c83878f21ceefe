"""Operators for building training corpora; each module states its method and how it treats odd rows."""
