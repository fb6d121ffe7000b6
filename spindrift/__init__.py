"""spindrift: select-project-join analytics, declared with DataFrames and planned before Catalyst sees them."""
