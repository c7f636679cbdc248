"""Multi-tenant lakehouse and document analytics as DataFrame operators."""
