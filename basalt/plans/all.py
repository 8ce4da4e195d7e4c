"""Imports every module that registers operators and gives the filled registry."""

from __future__ import annotations

import basalt.operators.audit
import basalt.operators.catalog
import basalt.operators.dialects
import basalt.operators.dml
import basalt.operators.geo
import basalt.operators.graph
import basalt.operators.metadata
import basalt.operators.quantified
import basalt.operators.relational
import basalt.operators.scalar
import basalt.operators.security
import basalt.operators.text
import basalt.operators.tpch
import basalt.operators.vector
import basalt.plans.recursion
import basalt.plans.unified
import basalt.sources.files
import basalt.streaming.windows  # noqa: F401
from basalt.plans.registry import OPERATORS

__all__ = ["OPERATORS"]
