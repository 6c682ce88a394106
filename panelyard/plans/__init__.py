"""End-to-end research jobs composed from the operators."""
