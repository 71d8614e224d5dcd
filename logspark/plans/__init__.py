"""Composed plans: table bindings, end-to-end flows, registered queries and their oracles."""
