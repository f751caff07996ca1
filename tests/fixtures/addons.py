"""A synthetic add-on tree with the cases the extractors and tools must handle."""

import os
import textwrap

FILES = {
    "fx_base/__manifest__.py": "{'name': 'Base', 'version': '17.0.1.0', 'depends': ['core'], 'category': ' Sales ', 'auto_install': False}",
    "fx_base/models/order.py": '''
        from sable import api, fields, models
        from sable.exceptions import ValidationError

        class FxOrder(models.Model):
            _name = 'fx.order'
            _inherit = ['fx.mixin']
            _description = 'Fixture order'
            _inherits = {'fx.partner': 'partner_id'}

            name = fields.Char('Reference', required=True)
            state = fields.Selection([('draft', 'Draft'), ('done', 'Done')], default='draft')
            partner_id = fields.Many2one('fx.partner', string='Partner', groups='base.user, base.admin')
            line_ids = fields.One2many('fx.line', 'order_id')
            total = fields.Float(compute='_compute_total', digits=(16, 2))
            country = fields.Char(related='partner_id.country_id.name')
            broken = fields.Char(related='partner_id.gone.name')

            @api.depends('line_ids.price', 'partner_id')
            @api.depends_context('lang')
            def _compute_total(self):
                for rec in self:
                    rec.total = sum(rec.line_ids.mapped('price'))

            @api.constrains('name')
            def _check_name(self):
                if not self.name:
                    raise ValidationError('no name')

            @api.onchange('partner_id')
            def _onchange_partner(self):
                self.env['fx.partner'].search([])
                self.env["fx.line"].browse(1)
                self.env['fx.partner'].browse(1)

            def action_done(self):
                self.write({'state': 'done'})
                self.state = 'done'
                self.status = 'closed'

            def run_job(self):
                return True

        class FxMixin(models.AbstractModel):
            _name = 'fx.mixin'
            note = fields.Text()

            def action_done(self):
                return True

            def mixin_only(self):
                return True

        class FxPartner(models.Model):
            _name = 'fx.partner'
            country_id = fields.Many2one(comodel_name='fx.country')

        class FxCountry(models.Model):
            _name = 'fx.country'
            name = fields.Char()

        class FxLine(models.Model):
            _name = 'fx.line'
            order_id = fields.Many2one('fx.order')
            price = fields.Float()
    ''',
    "fx_base/views/order.xml": '''<?xml version="1.0"?>
        <data_root><data>
          <record id="view_order_form" model="ir.ui.view">
            <field name="name">order form</field><field name="model">fx.order</field>
            <field name="arch" type="xml"><form><field name="name"/><field name="total" widget="money" groups="base.user"/><button name="action_done" type="object" invisible="state == 'done'"/><button name="%(fx_base.act_order)d" type="action"/></form></field>
          </record>
          <record id="act_order" model="ir.actions.act_window"><field name="name">Orders</field><field name="res_model">fx.order</field><field name="domain">[('state', '=', 'draft'), ('name', '!=', False)]</field></record>
          <menuitem id="menu_root" name="Root"/>
          <menuitem id="menu_order" name="Orders" parent="menu_root" action="act_order" sequence="bad" groups="base.user,base.admin"/>
          <record id="job" model="ir.cron"><field name="name">Job</field><field name="model_id" ref="model_fx_order"/><field name="code">model.run_job()</field><field name="interval_number" eval="2"/><field name="interval_type">hours</field></record>
          <record id="mail" model="mail.template"><field name="model_id" ref="model_fx_order"/><field name="subject">Order ${object.name}</field></record>
          <record id="rule" model="ir.rule"><field name="model_id" ref="model_fx_order"/><field name="domain_force">[('state', '=', 'draft')]</field><field name="groups" eval="[(4, ref('base.user'))]"/></record>
        </data><template id="report_order"><t t-call="web.layout"/><span t-field="doc.name" t-if="doc.state"/></template></data_root>
    ''',
    "fx_base/security/ir.model.access.csv": "id,name,model_id:id,group_id:id,perm_read,perm_write,perm_create,perm_unlink\na1,order user,model_fx_order,base.user,1,0,0,0\na2,line,fx.line,base.user,1,1,x,0\n",
    "fx_ext/__manifest__.py": "{'name': 'Ext', 'version': '17.0.2.0', 'depends': ['fx_base', 'web']}",
    "fx_ext/models/order_ext.py": '''
        class FxOrder(models.Model):
            _inherit = 'fx.order'
            extra = fields.Boolean()
            state = fields.Selection(selection_add=[('sent', 'Sent')])

            def action_done(self):
                return super().action_done()

        class FxSpecial(models.Model):
            _name = 'fx.special'
            _inherit = 'fx.order'

            def action_done(self):
                return False
    ''',
    "fx_ext/views/inherit.xml": '<odd_root><record id="view_order_inherit" model="ir.ui.view"><field name="model">fx.order</field><field name="inherit_id" ref="fx_base.view_order_form"/><field name="priority" eval="5"/><field name="arch" type="xml"><xpath expr="//field[@name=\'name\']" position="after"><field name="extra"/></xpath></field></record></odd_root>',
    "fx_web/__manifest__.py": "{'name': 'Web', 'version': '16.0.1.0'}",
    "fx_web/controllers/main.py": '''
        class Main(http.Controller):
            @http.route('/order/<int:order_id>/<string:token>', auth='public', methods=['POST'], csrf=False)
            def order(self, order_id, token):
                pass

            @http.route(['/a', '/b'], type='json')
            def several(self):
                pass
    ''',
    "fx_web/static/src/w.js": 'registry.category("actions").add("go", Go);\nregistry.category("odd").add("x", X);\nawait this.orm.call("fx.order", "action_done");\nrpc("/order/1");\nthis._rpc({ model: "m", route: "/legacy" });\n',
    "fx_web/static/src/lib/skip.js": 'rpc("/never");\n',
    "fx_web/tests/skip.xml": "<odd/>",
    "fx_legacy/__openerp__.py": "not a dict",
    "fx_legacy/models/bad.py": "def broken(:\n",
    "fx_legacy/views/bad.xml": "<a><b></a>",
    "demo_skip/__manifest__.py": "{}",
    "no_manifest/x.py": "x = 1\n",
}


def write(folder: str) -> str:
    for name, text in FILES.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        text = textwrap.dedent(text).lstrip("\n")
        with open(path, "w") as f:
            f.write(text.lstrip())
    return folder
