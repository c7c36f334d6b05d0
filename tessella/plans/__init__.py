"""Driver-side plans: key ranges of rectangles, layout models, partition budgets."""
