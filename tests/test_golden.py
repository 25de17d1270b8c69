"""A small project: all findings in report order, and files on which nothing is to be found."""

from lintlake.plans.review import Options, review

from .test_review import MAPPER, SERVICE, found, units

CLEAN_MAPPER = """<mapper namespace="demo.CleanMapper">
  <sql id="cols">id, name</sql>
  <select id="byId" resultType="U">select <include refid="cols"/> from users where id = #{id}</select>
  <select id="page" resultType="U">select id from users where name like concat(#{n}, '%') limit 10</select>
  <insert id="add">insert into users (id) values (#{id})</insert>
</mapper>
"""
CLEAN_CLASS = """package demo;
@Service
public class CleanService {
    private final CleanMapper cleanMapper;
    CleanService(CleanMapper m) { this.cleanMapper = m; }
    @Transactional(rollbackFor = Exception.class)
    public void place(Order o) throws IOException { cleanMapper.insertAll(o.items()); }
    @Cacheable(value = "c", key = "#id") public User load(Long id, boolean fresh) { return cleanMapper.findById(id); }
    @Cacheable("c") public User tagged(String[] tags, int n) { return null; }
    @Async public void fire() { }
}
"""
GOLDEN = [
    ("SPR002", "S.java", 8, "error"), ("SPR001", "S.java", 9, "error"), ("MYB002", "S.java", 11, "error"), ("SPR004", "S.java", 14, "error"), ("SPR003", "S.java", 18, "error"),
    ("MYB001", "m.xml", 4, "error"), ("MYB002", "m.xml", 7, "error"), ("MYB005", "m.xml", 9, "error"), ("MYB001", "m.xml", 15, "error"), ("MYB003", "m.xml", 17, "error"), ("MYB005", "m.xml", 20, "error"),
    ("SPR005", "S.java", 6, "warn"), ("SPR006", "S.java", 19, "warn"), ("SPR006", "S.java", 20, "warn"),
    ("MYB004", "m.xml", 11, "warn"), ("MYB003", "m.xml", 15, "warn"), ("MYB001", "m.xml", 16, "warn"), ("MYB005", "m.xml", 22, "warn"),
]


def test_findings_in_order_and_clean_files_silent(spark):
    from lintlake.operators.findings import ordering

    r = review(units(spark, ("S.java", SERVICE), ("m.xml", MAPPER), ("Clean.java", CLEAN_CLASS), ("clean.xml", CLEAN_MAPPER)), options=Options(experimental=True))
    got = [(x.rule, x.file, x.line, x.severity) for x in r.findings.orderBy(*ordering()).collect()]
    assert not {f for _, f, _, _ in got} - {"S.java", "m.xml"}
    assert [x for x in got if x[1] == "S.java"] == [x for x in GOLDEN if x[1] == "S.java"]
    assert got == GOLDEN
    assert r.skipped.count() == 0 and len(found(r)) == len(GOLDEN)
