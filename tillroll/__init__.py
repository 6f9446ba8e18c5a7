"""tillroll: customer-retention analytics over invoice lines, on Spark DataFrames."""

from tillroll.operators.clean import Cleaning
from tillroll.operators.slices import Slice
from tillroll.plans.context import Context
from tillroll.rules import Labels, Rules

__all__ = ["Cleaning", "Context", "Labels", "Rules", "Slice"]
